"""Price estimates, bands and confidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import col, col_or_null, days_between, lookup, round_even
from parcelgrid.functions.scalar import label_confidence
from parcelgrid.operators.ranking import attach
from parcelgrid.operators.spatial import density_count, freshness_max


def idw_estimate(requests: DataFrame, comps: DataFrame, request_id: str = "request_id") -> DataFrame:
    """Inverse-distance estimate from comparables: estimate, low, high, method."""
    weight = 1.0 / F.greatest(F.col("distance_m"), F.lit(100.0))
    used = comps.filter(F.col("price_per_sqm") > 0)
    stats = used.groupBy(request_id).agg(
        (F.sum(F.col("price_per_sqm") * weight) / F.sum(weight)).alias("ppsqm"),
        F.stddev_pop("price_per_sqm").alias("sd"), F.count("*").alias("n_comps"))
    joined = requests.select(request_id, "area_sqm").join(stats, request_id, "left")
    estimate, spread = F.col("ppsqm") * F.col("area_sqm"), F.col("sd") * F.col("area_sqm") * 1.5
    found = F.col("ppsqm").isNotNull()
    return joined.select(
        request_id, F.coalesce("n_comps", F.lit(0)).alias("n_comps"),
        F.when(found, round_even(estimate, -2)).otherwise(0.0).alias("estimate"),
        F.when(found, round_even(F.greatest(estimate - spread, estimate * 0.75), -2)).otherwise(0.0).alias("low"),
        F.when(found, round_even(estimate + spread, -2)).otherwise(0.0).alias("high"),
        F.when(found, "comparables").otherwise("no_data").alias("method"))


# --- Confidence ---------------------------------------------------------------------------------

def steps(value, table, otherwise) -> Column:
    """First result of a (test, result) table applied to a value."""
    out = None
    for test, result in table:
        cond = test(col(value))
        out = F.when(cond, F.lit(result)) if out is None else out.when(cond, F.lit(result))
    return out.otherwise(F.lit(otherwise))


def certainty_score(n) -> Column:
    return steps(n, [(lambda c: c >= 10, 100), (lambda c: c >= 5, 80), (lambda c: c >= 3, 50),
                     (lambda c: c >= 1, 25)], 0)


def freshness_score(days) -> Column:
    days = col(days)
    return F.when(days.isNull(), 0).otherwise(
        steps(days, [(lambda c: c <= 7, 100), (lambda c: c <= 30, 75), (lambda c: c <= 90, 50),
                     (lambda c: c <= 180, 25)], 10))


def density_score(n) -> Column:
    return F.least(F.coalesce(col(n), F.lit(0)) * 10, F.lit(100))


def completeness_score(df: DataFrame) -> Column:
    filled = sum((F.when(col_or_null(df, c, "string").isNotNull(), 1).otherwise(0)
                  for c in V.COMPLETENESS_FIELDS), F.lit(0))
    return filled / F.lit(len(V.COMPLETENESS_FIELDS)) * 100


def confidence_score(requests: DataFrame, listings: DataFrame, as_of, n_comps: str = "n_comps") -> DataFrame:
    """Adds score (0-100) and label from nearby density, completeness of the request,
    number of comparables and freshness of the data."""
    dense = density_count(requests, listings, as_of)
    fresh = freshness_max(dense, listings)
    total = (density_score("density_n") * 0.40 + completeness_score(requests) * 0.20
             + certainty_score(n_comps) * 0.25 + freshness_score("days_old") * 0.15)
    scored = fresh.withColumn("days_old", days_between(F.lit(as_of).cast("timestamp"), "latest"))
    scored = scored.withColumn("score", round_even(F.least(F.greatest(total, F.lit(0.0)), F.lit(100.0)), 1))
    return scored.withColumn("label", label_confidence("score"))


def enriched_confidence(missing, has_images) -> Column:
    """82, less 5 per missing high-impact input, 2 per other, 6 without photos; 30 to 95."""
    missing = F.array_distinct(col(missing))
    heavy = F.size(F.array_intersect(missing, F.array(*[F.lit(x) for x in V.HIGH_IMPACT_FEATURES])))
    score = F.lit(82.0) - heavy * 5.0 - (F.size(missing) - heavy) * 2.0
    score = score - F.when(col(has_images), 0.0).otherwise(6.0)
    return round_even(F.greatest(F.lit(30.0), F.least(F.lit(95.0), score)), 1)


# --- Model estimates ------------------------------------------------------------------------------

def band_width(mape, n_missing) -> Column:
    return F.least(F.greatest(col(mape) * 1.25, F.lit(0.12)) + col(n_missing) * 0.02, F.lit(0.45))


def valuation_band(estimate, mape, n_missing) -> Column:
    """struct(low, high) around an estimate; wider when important inputs are missing."""
    estimate, band = col(estimate), band_width(mape, n_missing)
    return F.struct(round_even(F.greatest(F.lit(0.0), estimate * (1 - band)), -2).alias("low"),
                    round_even(estimate * (1 + band), -2).alias("high"))


def ensemble_predict(log_a, log_b, weights=V.ENSEMBLE_WEIGHTS, country=None, factors=None) -> Column:
    """Weighted mean of two log-price predictions, as a price, after the country factor."""
    price = F.exp(col(log_a) * F.lit(weights[0]) + col(log_b) * F.lit(weights[1]))
    if country is None:
        return price
    factors = V.ADJUSTMENT_FACTORS if factors is None else factors
    return price * F.coalesce(lookup(factors, country), F.lit(1.0))


def method_router(has_model, confidence, n_comps) -> Column:
    return (F.when(col(has_model) & (col(confidence) >= 30), "model")
            .when(col(n_comps) > 0, "comparables").otherwise("no_data"))


def with_estimates(requests: DataFrame, comps: DataFrame, request_id: str = "request_id") -> DataFrame:
    return attach(requests, idw_estimate(requests, comps, request_id).drop("area_sqm"), [request_id])
