"""Composite jobs: item intake, quality run, page re-parse, yields, valuations, reports."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.sources.collections import union_collections
from parcelgrid.functions import features as X
from parcelgrid.functions.common import col_or_null, null_if_zero, round_even
from parcelgrid.functions.scalar import adjust_price, clean_item, condition_to_score, is_gozo, label_confidence
from parcelgrid.operators import history as H
from parcelgrid.operators import market as M
from parcelgrid.operators import quality as Q
from parcelgrid.operators import spatial as S
from parcelgrid.operators import training as T
from parcelgrid.operators import valuation as V
from parcelgrid.operators import yields as Y
from parcelgrid.operators.extract import page_records
from parcelgrid.operators.places import cache_key, join_geocode_cache, resolve_locality
from parcelgrid.plans.features import build_features, feature_names, with_map_features
from parcelgrid.plans.model import Trained, predict_log, train_cv
from parcelgrid.session import materialize
from parcelgrid.sources.sinks import export_rows


def prepare_items(items: DataFrame, cache: DataFrame, factors: Mapping[str, float] | None = None) -> DataFrame:
    """Clean, geocode from the cache, hash and adjust scraped items."""
    cleaned = clean_item(items)
    keyed = cleaned.withColumn("cache_key", cache_key("address_raw", "locality"))
    located = join_geocode_cache(keyed.withColumnsRenamed({"lat": "own_lat", "lon": "own_lon"}), cache)
    placed = located.withColumns({"lat": F.coalesce("own_lat", "lat"), "lon": F.coalesce("own_lon", "lon")}).drop(
        "own_lat", "own_lon", "cache_key", "status")
    return adjust_price(Q.with_dedup_hash(placed), factors)


def item_pipeline(items: DataFrame, cache: DataFrame, target: DataFrame, now, order_cols: Sequence[str],
                  factors: Mapping[str, float] | None = None, countries: DataFrame | None = None) -> DataFrame:
    """Scraped items into the relational table."""
    ready = prepare_items(items, cache, factors).withColumnsRenamed({"price": "price_eur", "price_adjusted": "price_adjusted_eur"})
    return Q.upsert_relational(target, ready, now, order_cols, countries)


def quality_pipeline(docs: DataFrame, by: Sequence[str] = ("source", "locality")) -> tuple[DataFrame, DataFrame]:
    """(marked documents, export rows).  Flags come first, then duplicates, so the flag
    for a duplicate appears with the next run."""
    flagged = Q.flag_suspicious(docs, Q.locality_medians(docs, by=by))
    marked = Q.mark_duplicates(flagged)
    return marked, export_rows(marked)


def reparse_pages(pages: DataFrame, state: DataFrame | None) -> tuple[H.Upsert, DataFrame, DataFrame]:
    """Parse stored pages again and upsert them; pages without a title go to quarantine.

    Returns the upsert, the quarantine and one row of items_new, items_updated, parse_errors.
    """
    records = page_records(pages)
    good = records.filter(F.col("title").isNotNull()).drop("page_id")
    bad = records.filter(F.col("title").isNull()).select("page_id", F.lit("empty parse result").alias("error"))
    done = H.upsert_listings(state, good)
    counts = done.counts.unionByName(bad.agg(F.count("*").alias("parse_errors")), allowMissingColumns=True)
    return done, bad, counts.agg(*[F.max(c).alias(c) for c in counts.columns])


# --- Yields ---------------------------------------------------------------------------------------------

def map_position(docs: DataFrame) -> tuple[Column, Column]:
    """The precise map point, else the listing's own position."""
    return tuple(F.coalesce(null_if_zero(col_or_null(docs, f"map_{c}", "double")), F.col(c)) for c in ("lat", "lon"))


def rental_points(docs: DataFrame, property_type: str = "apartment") -> DataFrame:
    """Positions of all rentals of a type, over every source."""
    rentals = docs.filter((F.col("listing_type") == "rent") & (F.col("property_type") == property_type))
    lat, lon = map_position(docs)
    return rentals.select(lat.alias("lat"), lon.alias("lon")).filter((F.col("lat") != 0) & (F.col("lon") != 0))


def matrix_for(docs: DataFrame, listing_type: str, as_of, pois: DataFrame, populations: DataFrame,
               features: DataFrame | None = None, overrides: DataFrame | None = None,
               property_type: str = "apartment") -> DataFrame:
    usable = T.usable_rows(T.training_filter(docs, property_type, listing_type))
    return build_features(usable, as_of, pois, populations, rental_points(docs, property_type), features, overrides)


def rental_yields(docs: DataFrame, as_of, pois: DataFrame, populations: DataFrame, features: DataFrame | None = None,
                  city: str | None = None, min_yield: float = 0.0, investable: bool = False, max_age_days: int = 365,
                  min_rentals: int = 0, rent_model: Trained | None = None, columns: list[str] | None = None,
                  **training) -> DataFrame:
    """Ranked gross yields of sale listings from a rent model, with warnings, the rentals most alike and the yield that these give."""
    columns = columns or feature_names()
    if rent_model is None:
        rent_model = train_cv(materialize(matrix_for(docs, "rent", as_of, pois, populations, features)), columns, **training)
    sales = matrix_for(docs, "sale", as_of, pois, populations, features)
    if city:
        sales = sales.filter(F.lower("locality").contains(city.lower()))
    sales = materialize(sales)
    scored = predict_log(sales, columns, rent_model.boosted, rent_model.second)
    rent = V.ensemble_predict("log_a", "log_b")
    scored = scored.withColumn("predicted_rent", rent).withColumn("gross_yield", Y.gross_yield("predicted_rent", "price_eur"))
    if investable:
        scored = Y.investable_filter(scored, max_age_days)
    scored = Y.min_rentals_filter(scored, docs, min_rentals)
    noted = with_notes(scored.filter(F.col("gross_yield") >= min_yield), features)
    # rows have a number of their own, as ids may repeat
    ranked = materialize(noted.withColumn("warnings", Y.yield_warnings(noted)).drop("data_quality_note").withColumn("__row", F.monotonically_increasing_id()))
    comps = materialize(yield_comparables(ranked, docs, features, sale_id="__row"))
    alike = comps.groupBy("sale_id").agg(F.sort_array(F.collect_list(
        F.struct("rank", "rental_id", "rent_eur", "dist_km", "similarity"))).alias("comparables"))
    out = ranked
    for found in (Y.comp_yield(comps, ranked, "__row"), alike):
        out = out.join(found.withColumnRenamed("sale_id", "__row"), "__row", "left")
    out = out.withColumn("n_comps", F.coalesce("n_comps", F.lit(0))).drop("__row")
    return out.orderBy(F.desc("gross_yield"), "doc_id")


def with_notes(df: DataFrame, features: DataFrame | None) -> DataFrame:
    """Adds `data_quality_note` of an enrichment run that has it."""
    if features is None or "data_quality_note" not in features.schema["features"].dataType.fieldNames():
        return df
    return df.join(features.select("doc_id", F.col("features.data_quality_note").alias("data_quality_note")), "doc_id", "left")


def yield_comparables(top: DataFrame, docs: DataFrame, features: DataFrame | None = None, property_type: str = "apartment",
                      sale_id: str = "doc_id") -> DataFrame:
    """Most alike rentals for the rows of a yield report."""
    rentals = docs.filter((F.col("listing_type") == "rent") & (F.col("property_type") == property_type))
    lat, lon = map_position(docs)
    rentals = rentals.withColumns({"lat": lat, "lon": lon})
    if features is not None:
        text = features.select("doc_id", F.col("features.condition").alias("condition"),
                               F.col("features.actual_living_area").alias("living"))
        rentals = rentals.drop("condition").join(text, "doc_id", "left").withColumn(
            "area_sqm", F.coalesce(null_if_zero("area_sqm"), F.col("living").cast("double")))
    for name in ("rooms", "condition"):
        if name not in rentals.columns:
            rentals = rentals.withColumn(name, F.lit(None).cast("double"))
    return S.similar_rentals(top.withColumn("condition", F.col("llm_condition")), rentals, sale_id=sale_id)


# --- Valuations -------------------------------------------------------------------------------------------

def request_features(requests: DataFrame, centroids: DataFrame, pois: DataFrame) -> DataFrame:
    """Requests with the model's columns, and the list of inputs nobody supplied.

    `requests` holds doc_id, the form's fields and `text`, the text-derived struct.
    """
    text = set(requests.schema["text"].dataType.fieldNames()) if "text" in requests.columns else set()

    def said(name, dtype):
        return F.col(f"text.{name}") if name in text else F.lit(None).cast(dtype)

    named = resolve_locality(requests.withColumnRenamed("locality", "asked_locality"), centroids, name="asked_locality")
    living = said("actual_living_area", "double")
    area = F.when(living > 10, living.cast("double")).otherwise(F.col("area_sqm").cast("double"))
    view = said("view", "string")
    known = named.withColumn("locality_enc", F.col("locality"))
    known = known.withColumn("missing_features", X.missing_feature_list(known)).drop("locality_enc")
    for c in ("total_int_area", "total_ext_area", "rooms", "bathrooms", "bedrooms", "floor", "total_floors",
              "has_balcony", "has_pool", "has_elevator", "has_garden", "condition"):
        if c not in known.columns:
            known = known.withColumn(c, F.lit(None).cast("string" if c == "condition" else "double"))
    known = known.withColumns({"area_sqm": area, "area_sqm_log": F.when(area > 0, F.log(area))})
    known = X.impute_structural(known)
    encoded = X.encode_text_features(known, "text")

    encoded = encoded.withColumns({
        "llm_condition": condition_to_score("condition", said("condition", "long")).cast("double"),
        "is_premium_zone": F.lit(0.0), "is_resort": F.lit(0.0), "is_city_center": F.lit(0.0),
        "is_gozo": is_gozo("lat").cast("double"), "is_near_beach": said("sea_proximity", "boolean").cast("double"),
        "is_seafront": X.flag(view == "sea"), "is_sea_view": X.flag(view.isin("sea", "harbour")),
        "is_quiet_road": said("quiet", "boolean").cast("double"), "is_countryside": X.flag(view == "valley"),
        "has_balcony": F.col("has_balcony").cast("double"), "has_pool": F.col("has_pool").cast("double"),
        "has_lift": F.col("has_elevator").cast("double"), "has_yard": F.col("has_garden").cast("double"),
        "struct_floor": F.col("floor").cast("double"), "struct_total_floors": F.col("total_floors").cast("double"),
        "province": F.lit("Unknown")})
    out = with_map_features(encoded, pois)
    absent = [c for c in feature_names() if c not in out.columns and c not in ("locality_enc", "province_enc")]
    return out.withColumns({c: F.lit(None).cast("double") for c in absent}) if absent else out


def batch_valuation(requests: DataFrame, models: dict[str, tuple[Trained, float]], centroids: DataFrame, pois: DataFrame,
                    columns: list[str] | None = None, version: str = "v1") -> DataFrame:
    """Scores a table of requests: estimate, band, confidence and price per m².

    `models` has a model and its mean percentage error for each listing type; requests
    of a type without a model are left out.
    """
    return union_collections([_valued(requests.filter(F.col("listing_type") == deal), model, mape, centroids, pois, columns, version)
                              for deal, (model, mape) in models.items()])


def _valued(requests: DataFrame, model: Trained, mape: float, centroids: DataFrame, pois: DataFrame,
            columns: list[str] | None, version: str) -> DataFrame:
    columns = columns or feature_names(serve_consistent=True)
    ready = request_features(requests, centroids, pois)
    scored = predict_log(ready, columns, model.boosted, model.second)
    raw = V.ensemble_predict("log_a", "log_b", country="country")
    out = scored.withColumn("raw_estimate", raw)
    band = V.valuation_band("raw_estimate", F.lit(mape / 100), F.size("missing_features"))
    images = F.coalesce(col_or_null(out, "has_images", "boolean"), F.lit(False))
    out = out.withColumns({"band": band, "estimate": round_even("raw_estimate", -2),
                           "confidence_score": V.enriched_confidence("missing_features", images)})
    return out.select(
        "doc_id", "locality", "method", "estimate", F.col("band.low").alias("confidence_low"), F.col("band.high").alias("confidence_high"),
        "confidence_score", label_confidence("confidence_score").alias("confidence_label"),
        F.when(F.col("area_sqm") != 0, round_even(F.col("estimate") / F.col("area_sqm"), 2)).otherwise(0.0).alias("price_per_sqm"),
        "missing_features", F.lit(version).alias("model_version"))


def comparables_valuation(requests: DataFrame, properties: DataFrame, as_of, has_model: bool = False) -> DataFrame:
    """The path without a model: nearest comparables, estimate, confidence, method."""
    comps = S.comparables_api(requests, properties)
    estimates = V.idw_estimate(requests, comps)
    asked = requests.join(estimates.drop("area_sqm"), "request_id")
    scored = V.confidence_score(asked, properties, as_of)
    return scored.select("request_id", "estimate", "low", "high", "score", "label", "n_comps",
                         V.method_router(F.lit(has_model), "score", "n_comps").alias("method"))


# --- Reports ------------------------------------------------------------------------------------------------

def market_report(docs: DataFrame, events: DataFrame | None = None) -> dict[str, DataFrame]:
    """The summary report as a set of small tables."""
    out = {"collections": M.collection_summary(docs), "countries": M.country_price_stats(docs),
           "property_types": M.value_counts(docs, "property_type", default="unknown"),
           "localities": M.value_counts(docs, "locality", 10), "market": M.market_stats(docs)}
    if events is not None:
        out["events"] = H.event_counts(events)
    return out
