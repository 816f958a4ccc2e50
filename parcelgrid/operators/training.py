"""Training-set preparation, folds, encodings and metrics."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import col_or_null, filled, null_if_zero, round_even
from parcelgrid.functions.scalar import clean_area, combine_city_locality, normalize_vat_price
from parcelgrid.operators.ranking import dense_positions, attach, exact_percentiles, rank_within, tile


# --- Filters ---------------------------------------------------------------------------------

def rent_period(df: DataFrame, raw: str = "raw_data") -> Column:
    """`Period` of the raw JSON record, or of its first element when it is a list."""
    text = col_or_null(df, raw, "string")
    return F.coalesce(F.get_json_object(text, "$.Period"), F.get_json_object(text, "$[0].Period"),
                      F.lit("Monthly"))


def rent_period_filter(df: DataFrame, raw: str = "raw_data") -> Column:
    return rent_period(df, raw) == "Monthly"


def training_filter(df: DataFrame, property_type: str, listing_type: str) -> DataFrame:
    """Adds `reject_reason` (first failing rule, NULL when usable), `clean_area`, the
    usable coordinates and the locality that includes the city."""
    if (property_type, listing_type) not in V.TRAINING_BOUNDS:
        raise ValueError(f"no bounds for {(property_type, listing_type)}")
    b = V.TRAINING_BOUNDS[(property_type, listing_type)]
    lat = F.coalesce(null_if_zero("lat"), null_if_zero(col_or_null(df, "map_lat", "double")))
    lon = F.coalesce(null_if_zero("lon"), null_if_zero(col_or_null(df, "map_lon", "double")))
    price = normalize_vat_price("price_eur", col_or_null(df, "vat_status", "string"))
    area = clean_area("area_sqm")
    outside = (price < b["min_price"]) | (price > b["max_price"])
    rule = F.when(~F.coalesce(F.col("property_type") == property_type, F.lit(False)), "type")
    rule = rule.when(~F.coalesce(F.col("listing_type") == listing_type, F.lit(False)), "listing")
    rule = rule.when(F.coalesce(F.size(col_or_null(df, "suspicious", "array<string>")) > 0, F.lit(False)), "suspicious")
    rule = rule.when(filled(col_or_null(df, "duplicate_of", "string")), "duplicate")
    rule = rule.when(~F.coalesce(F.col("price_eur") > 0, F.lit(False)), "no_price")
    rule = rule.when(lat.isNull() | lon.isNull(), "no_coords")
    if listing_type == "rent":
        rule = rule.when(~rent_period_filter(df), "non_monthly")
    rule = rule.when(outside, "price_outlier")
    rule = rule.when((area < b["min_area"]) | (area > b["max_area"]), "area_outlier")
    if b["require_area"]:
        rule = rule.when(area.isNull(), "no_area")
    if listing_type == "sale":
        low, high = V.SALE_PPSQM_BOUNDS
        rule = rule.when((price / area > high) | (price / area < low), "price_outlier")
    address = col_or_null(df, "address_raw", "string")
    return df.withColumns({
        "reject_reason": rule, "clean_area": area, "lat": lat, "lon": lon,
        "locality": combine_city_locality("locality", address, "country")})


def skip_counts(df: DataFrame) -> DataFrame:
    return (df.filter(F.col("reject_reason").isNotNull()).groupBy("reject_reason")
            .agg(F.count("*").alias("n")))


# --- Folds and codes ---------------------------------------------------------------------------

def spatial_folds(df: DataFrame, k: int = V.N_FOLDS, by: str | None = "locality",
                  id_col: str = "doc_id", lat: str = "lat") -> DataFrame:
    """Adds `fold` 0..k-1: each locality's listings, ordered by latitude, in k even parts."""
    ranked = rank_within(df, [by] if by else [], lat, id_col)
    return ranked.withColumn("fold", tile("rank", "group_size", k)).drop("rank", "group_size")


def latitude_strips(df: DataFrame, k: int = V.N_FOLDS, id_col: str = "doc_id", lat: str = "lat") -> DataFrame:
    return spatial_folds(df, k, None, id_col, lat)


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Alphabetical zero-based code of every distinct value; ranges of values are sorted apart."""
    values = df.select(F.col(column).alias("value")).filter("value IS NOT NULL").distinct()
    return dense_positions(values, [F.col("value")], "code").select("value", F.col("code").cast("int"))


def with_codes(df: DataFrame, column: str, codes: DataFrame, out: str) -> DataFrame:
    coded = attach(df, codes.select(F.col("value").alias(column), F.col("code").alias(out)), [column])
    return coded.withColumn(out, F.coalesce(F.col(out), F.lit(-1)).cast("double"))


def target_encode(train: DataFrame, apply: DataFrame, column: str, target: str,
                  smoothing: float = 10.0, out: str = "enc") -> DataFrame:
    """Adds the smoothed mean target of the row's category; unseen gets the overall mean."""
    overall = train.agg(F.avg(target)).scalar()
    sums = (train.filter(F.col(column).isNotNull()).groupBy(column)
            .agg(F.sum(target).alias("__s"), F.count(target).alias("__n")))
    joined = attach(apply, sums, [column])
    smooth = (F.col("__s") + F.lit(smoothing) * overall) / (F.col("__n") + F.lit(smoothing))
    return joined.withColumn(out, F.coalesce(smooth, overall)).drop("__s", "__n")


def sale_rent_locality_codes(sales: DataFrame, codes: DataFrame, column: str = "locality",
                             out: str = "locality_enc") -> DataFrame:
    """Codes learnt on rentals for sale localities; an unknown one gets the median code."""
    middle = exact_percentiles(codes.select(F.col("code").cast("double").alias("code")), [], "code",
                               {"m": 0.5}).select("m").scalar()
    joined = attach(sales, codes.select(F.col("value").alias(column), F.col("code").cast("double").alias("__c")), [column])
    return joined.withColumn(out, F.coalesce(F.col("__c"), middle)).drop("__c")


# --- Metrics ------------------------------------------------------------------------------------

def regression_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE, R², MAPE %, median absolute error and n; overall or per group."""
    by = list(by)
    err = df.withColumn("__e", F.abs(F.col(y) - F.col(yhat)))
    sums = err.groupBy(*by).agg(
        F.avg("__e").alias("mae"), F.avg(F.col("__e") * F.col("__e")).alias("mse"),
        F.var_pop(y).alias("vy"), F.avg(F.col("__e") / F.abs(F.col(y))).alias("mape"), F.count("*").alias("n"))
    med = exact_percentiles(err, by, "__e", {"median_ae": 0.5}).drop("n")
    joined = attach(sums, med, by, "inner")
    return joined.select(
        *by, round_even("mae", 2).alias("mae"), round_even(F.sqrt("mse"), 2).alias("rmse"),
        round_even(1 - F.col("mse") / F.col("vy"), 4).alias("r2"),
        round_even(F.col("mape") * 100, 2).alias("mape_pct"), round_even("median_ae", 2).alias("median_ae"), "n")


def accuracy_buckets(df: DataFrame, y: str = "y", yhat: str = "yhat", by: Sequence[str] = ()) -> DataFrame:
    pct = F.abs((F.col(y) - F.col(yhat)) / F.col(y)) * 100
    return df.groupBy(*by).agg(*[
        round_even(F.avg(F.when(pct <= k, 1.0).otherwise(0.0)) * 100, 1).alias(f"within_{k}pct")
        for k in (5, 10, 15, 20, 25)])


def feature_coverage(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Non-missing count and share of each feature, from one pass."""
    one = df.agg(F.count("*").alias("total"), *[F.count(c).alias(c) for c in features])
    return (one.unpivot("total", list(features), "feature", "n")
            .select("feature", "n", round_even(F.col("n") * 100.0 / F.col("total"), 1).alias("pct")))


def price_quantiles(df: DataFrame, value: str = "price_eur") -> DataFrame:
    return exact_percentiles(df, [], value, {"min": 0.0, "p5": 0.05, "median": 0.5, "p95": 0.95, "max": 1.0})


def winsorize_prices(df: DataFrame, lo: float = 0.01, hi: float = 0.99, value: str = "price_eur") -> DataFrame:
    bounds = exact_percentiles(df, [], value, {"lo": lo, "hi": hi})
    low, high = bounds.select("lo").scalar(), bounds.select("hi").scalar()
    return df.withColumn(value, F.when(F.col(value).isNotNull(), F.least(F.greatest(F.col(value), low), high)))


def normalized_importance(importances: DataFrame, n: int = 20) -> DataFrame:
    """Largest shares of total importance."""
    total = importances.agg(F.sum("importance")).scalar()
    share = F.when(total != 0, F.col("importance") / total).otherwise(0.0)
    return (importances.select("feature", share.alias("s")).orderBy(F.desc("s"), "feature").limit(n)
            .select("feature", round_even("s", 3).alias("share")))


# --- Stored training sets and models ---------------------------------------------------------------

SQL_TRAINING_COLUMNS = (
    "id", "lat", "lon", "property_type", "area_sqm", "floor", "total_floors", "rooms", "bedrooms",
    "bathrooms", "year_built", "year_renovated", "condition", "has_parking", "has_garden", "has_pool",
    "has_elevator", "has_balcony", "distance_coast_m", "distance_center_m", "price_adjusted_eur",
    "price_type", "listing_date", "transaction_date")
#: Types of columns that a source may lack; all others are numbers.
SQL_TRAINING_TYPES = {
    "id": "long", "property_type": "string", "condition": "string", "price_type": "string", "listing_date": "timestamp",
    "transaction_date": "timestamp", "has_parking": "boolean", "has_garden": "boolean", "has_pool": "boolean",
    "has_elevator": "boolean", "has_balcony": "boolean"}


def feature_store_join(properties: DataFrame, countries: DataFrame, regions: DataFrame) -> DataFrame:
    """Properties with their country code and, where known, their region's name."""
    codes = countries.select(F.col("id").alias("country_id"), F.col("code").alias("country_code"))
    names = regions.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    return properties.join(codes, "country_id").join(names, "region_id", "left")


def read_sql_training(properties: DataFrame, countries: DataFrame, regions: DataFrame, code: str) -> DataFrame:
    """Usable rows of one country; columns a source lacks come out NULL."""
    valid = properties.filter((F.col("price_adjusted_eur") > 0) & F.col("lat").isNotNull()
                              & F.col("lon").isNotNull() & (F.col("area_sqm") > 0))
    joined = feature_store_join(valid, countries.filter(F.col("code") == code.upper()), regions)
    return joined.select(*[col_or_null(joined, c, SQL_TRAINING_TYPES.get(c, "double")).alias(c) for c in SQL_TRAINING_COLUMNS], "region_name")


ARTIFACT_KINDS = ("boosted", "second", "encoders", "meta")


def complete_versions(artifacts: DataFrame, kinds: Sequence[str] = ARTIFACT_KINDS,
                      by: Sequence[str] = ("model",)) -> DataFrame:
    """Newest version for which every kind of artifact exists, per model."""
    full = (artifacts.filter(F.col("kind").isin(*kinds)).groupBy(*by, "version")
            .agg(F.count_distinct("kind").alias("k")).filter(F.col("k") == len(kinds)))
    return full.groupBy(*by).agg(F.max("version").alias("version"))


def usable_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("reject_reason").isNull())


