"""Estimates, bands, models and composite jobs."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from parcelgrid.checks.market import _AVG, _BY, r
from parcelgrid.checks.quality import EVENTS, FLAGGED, KEYED, TITLED, all_events, titled  # noqa: F401
from parcelgrid.checks.registry import AS_OF, query
from parcelgrid.checks.spatial import DENSITY_AS_OF, priced_properties
from parcelgrid.functions.common import round_even
from parcelgrid.functions.responses import with_text_features
from parcelgrid.functions.scalar import detect_country_from_coords
from parcelgrid.operators import valuation as V
from parcelgrid.plans import model as MO
from parcelgrid.plans import pipelines as PL
from parcelgrid.plans.features import feature_names
from parcelgrid.session import fresh_path, materialize

# --- Scoring expressions -----------------------------------------------------------------------------
query("valuation_band", f"""
SELECT doc_id, {r('greatest(0, price_eur * (1 - b))', -2)} AS low, {r('price_eur * (1 + b)', -2)} AS high FROM (SELECT doc_id, price_eur,
  least(greatest(m * 1.25::DOUBLE, 0.12::DOUBLE) + ok % 20 * 0.02::DOUBLE, 0.45::DOUBLE) AS b FROM (SELECT *, pk % 30 / CAST(100 AS DOUBLE) AS m FROM listings))""")(
    lambda t: t.listings.select("doc_id", V.valuation_band("price_eur", F.col("pk") % 30 / F.lit(100.0), F.col("ok") % 20).alias("b")).select("doc_id", "b.low", "b.high"))
query("ensemble_predict", f"""
SELECT doc_id, {r("exp(0.85::DOUBLE * ln(price_eur) + 0.15::DOUBLE * ln(area_sqm * 2000)) * CASE country WHEN 'MT' THEN 0.97::DOUBLE ELSE 0.93::DOUBLE END", 3)} AS price
FROM listings WHERE price_eur > 0""")(
    lambda t: t.listings.filter("price_eur > 0").select("doc_id", round_even(V.ensemble_predict(F.log("price_eur"), F.log(F.col("area_sqm") * 2000), country="country"), 3).alias("price")))
query("enriched_confidence", f"""
SELECT doc_id, {r("greatest(30, least(95, 82 - 5 * (CAST(ok % 2 = 0 AS INT) + CAST(ok % 3 = 0 AS INT)) - 2 * (CAST(ok % 5 = 0 AS INT) + CAST(pk % 2 = 0 AS INT)) - CASE WHEN pk % 3 = 0 THEN 0 ELSE 6 END))", 1)} AS score FROM listings""")(
    lambda t: t.listings.select("doc_id", V.enriched_confidence(F.array_compact(F.array(
        F.when(F.col("ok") % 2 == 0, "locality_enc"), F.when(F.col("ok") % 3 == 0, "llm_condition"), F.when(F.col("ok") % 5 == 0, "rooms"),
        F.when(F.col("pk") % 2 == 0, "bathrooms"), F.when(F.col("ok") % 5 == 0, "rooms"))), F.col("pk") % 3 == 0).alias("score")))
query("method_router", """
SELECT doc_id, CASE WHEN ok % 2 = 0 AND pk % 100 >= 30 THEN 'model' WHEN ok % 3 > 0 THEN 'comparables' ELSE 'no_data' END AS method FROM listings""")(
    lambda t: t.listings.select("doc_id", V.method_router(F.col("ok") % 2 == 0, F.col("pk") % 100, F.col("ok") % 3).alias("method")))

# --- Composite jobs with exact results --------------------------------------------------------------------
query("quality_pipeline", f"""
, {FLAGGED}, {KEYED}, dup AS (SELECT doc_id, CASE WHEN has_key THEN nullif(first_id, doc_id) END AS duplicate_of FROM (SELECT *, min(doc_id) OVER (PARTITION BY has_key, kp, ka, kt) AS first_id FROM keyed))
SELECT f.doc_id AS external_id, f.price_eur, {r('price_eur / area_sqm', 2)} AS price_per_sqm FROM flagged f JOIN dup USING (doc_id)
WHERE flags = '' AND duplicate_of IS NULL AND lat <> 0 AND lon <> 0 AND price_eur <> 0 AND area_sqm <> 0 AND is_active""")(
    lambda t: PL.quality_pipeline(titled(t), by=("locality",))[1].select("external_id", "price_eur", "price_per_sqm"))
_ITEM = f"CASE WHEN ok % 5 = 0 THEN {r('price_eur * (1 / CAST(1.95583 AS DOUBLE))', 2)} ELSE price_eur END"
query("item_pipeline", f"""
, hashed AS (SELECT substr(sha256(concat(source, ':', doc_id)), 1, 16) AS h, * FROM texts),
tgt AS (SELECT h, pk FROM hashed WHERE pk % 3 = 0), bat AS (SELECT h, {_ITEM} AS price, property_type, locality, lat FROM hashed WHERE price_eur <> 0)
SELECT COALESCE(tgt.h, bat.h) AS dedup_hash, CASE WHEN bat.h IS NULL THEN 1.0::DOUBLE + pk ELSE bat.price END AS price_eur,
  CASE WHEN tgt.h IS NULL THEN bat.property_type ELSE 'stored' END AS property_type, CASE WHEN tgt.h IS NULL THEN bat.locality ELSE 'Stored' END AS locality,
  CASE WHEN tgt.h IS NULL THEN bat.lat END AS lat, bat.h IS NOT NULL AS is_active,
  CASE WHEN tgt.h IS NULL THEN TIMESTAMP '{AS_OF}' ELSE TIMESTAMP '2020-01-01' END AS created_at,
  CASE WHEN bat.h IS NULL THEN TIMESTAMP '2020-01-02' ELSE TIMESTAMP '{AS_OF}' END AS scraped_at
FROM tgt FULL JOIN bat ON tgt.h = bat.h""", ("texts",))(lambda t: _items(t))


def _items(t):
    """A third of the items are stored already, some of which the batch leaves out."""
    items = t.texts.select("doc_id", "source", F.col("doc_id").alias("external_id"), F.col("price_eur").alias("price"), "price_currency", "address_raw", "locality",
                           F.upper("property_type").alias("property_type"), "area_sqm", "lat", "lon", F.col("country").alias("country_code"))
    target = t.texts.filter("pk % 3 = 0").select(
        F.substring(F.sha2(F.concat("source", F.lit(":"), "doc_id").cast("binary"), 256), 1, 16).alias("dedup_hash"), (F.col("pk") + 1.0).alias("price_eur"),
        F.lit(None).cast("double").alias("price_adjusted_eur"), F.lit("stored").alias("property_type"), F.lit("Stored").alias("locality"),
        F.lit(None).cast("double").alias("lat"), F.lit(False).alias("is_active"), F.lit("2020-01-01").cast("timestamp").alias("created_at"),
        F.lit("2020-01-02").cast("timestamp").alias("scraped_at"))
    out = PL.item_pipeline(items, t.geocode_cache, target, AS_OF, ["doc_id"], countries=t.countries)
    return out.select("dedup_hash", "price_eur", "property_type", "locality", "lat", "is_active", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                      F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"))


query("market_report", f""", {EVENTS}
SELECT 'countries' AS part, country AS name, count(*) AS n, {r('avg(price_eur)', 4)} AS avg_price FROM listings WHERE price_eur > 0 GROUP BY country
UNION ALL SELECT 'property_types', property_type, count(*), NULL FROM listings GROUP BY property_type
UNION ALL SELECT * FROM (SELECT 'localities', locality, count(*) AS n, NULL FROM listings GROUP BY locality ORDER BY n DESC, locality LIMIT 10)
UNION ALL SELECT 'collections', source, count(*), {r('avg(price_eur)', 4)} FROM listings GROUP BY source
UNION ALL SELECT concat('market ', "by"), name, n, avg_price FROM (SELECT * FROM ({_BY.format('locality', _AVG)} ORDER BY n DESC, name LIMIT 30)
  UNION ALL {_BY.format('property_type', _AVG)} UNION ALL {_BY.format('country', _AVG)})
UNION ALL SELECT 'events', event, count(*), NULL FROM events_all GROUP BY event""", ("listings", "batch1", "batch2"))(lambda t: _report(t))


def _report(t):
    """All parts of the report as one table."""
    parts = PL.market_report(t.listings, all_events(t))
    none = F.lit(None).cast("double").alias("avg_price")
    avg = round_even("avg_price", 4).alias("avg_price")

    def rows(part, name, price, label=None):
        return parts[part].select((label if label is not None else F.lit(part)).alias("part"), F.col(name).alias("name"), "n", price)

    return (rows("countries", "country", avg).unionByName(rows("property_types", "value", none)).unionByName(rows("localities", "value", none))
            .unionByName(rows("collections", "source", avg)).unionByName(rows("market", "name", avg, F.concat(F.lit("market "), F.col("by"))))
            .unionByName(rows("events", "event", none)))


# --- Model jobs: rows only ------------------------------------------------------------------------------------
def located_pois(t):
    return t.pois.withColumn("country", F.coalesce(detect_country_from_coords("lat", "lon"), F.lit("MT")))


def populations(t):
    return t.nation.select(F.when(F.col("n_nationkey") % 2 == 0, "BG").otherwise("MT").alias("country"), F.col("n_name").alias("city"), (F.col("n_nationkey") * 1000 + 500).cast("long").alias("population"))


def run_features(t):
    return t.text_features.select("doc_id", F.struct("condition", "construction_status", "quality_tier", "actual_living_area").alias("features"))


def matrix(t, deal):
    return PL.matrix_for(t.listings, deal, AS_OF, located_pois(t), populations(t), run_features(t))


query("build_features")(lambda t: matrix(t, "sale"))
def trained(t, deal="rent"):
    return MO.train_cv(materialize(matrix(t, deal)), feature_names())


query("train_cv")(lambda t: trained(t).metrics)
query("monotonicity_check")(lambda t: _monotone(t))


def _monotone(t):
    m = materialize(matrix(t, "sale"))
    model = MO.train_cv(m, feature_names(), objective="huber", monotone=True)
    return MO.monotonicity_check(m, feature_names(), model.boosted, model.second)


def mean_error(model):
    """Mean percentage error of cross-validation."""
    return float(model.metrics.first()["mape_pct"])


def _registry(t):
    root = fresh_path(t.spark, "models")
    rows = materialize(matrix(t, "rent"))
    for version, objective, day in (("v9", "l2", 1), ("v10", "l1", 2)):
        model = MO.train_cv(rows, feature_names(), objective=objective)
        MO.register_model(t.spark, root, "apartment_rent", version, model, mean_error(model), datetime(2026, 6, day))
    rows = t.spark.read.schema(MO.REGISTRY).parquet(f"{root}/_registry")
    return MO.model_registry(rows, "apartment_rent").select("version", "kind", "mape")


query("model_registry")(_registry)
query("rental_yields")(
    lambda t: PL.rental_yields(t.listings, AS_OF, located_pois(t), populations(t), run_features(t))
    .select("doc_id", "locality", "price_eur", "predicted_rent", "gross_yield", "warnings", "n_comps", "avg_rent", "comp_yield", "comparables"))


def valuation_requests(t):
    asked = t.requests.withColumn("doc_id", F.col("request_id").cast("string")).withColumn(
        "response", F.concat(F.lit('{"condition": '), (F.col("request_id") % 5 + 1).cast("string"), F.lit(', "view": "sea"}')))
    return with_text_features(asked.withColumn("locality", F.lit(None).cast("string")), "response").select(
        "doc_id", "country", "listing_type", "lat", "lon", "locality", "area_sqm", "text")


def score_requests(t, requests, models):
    return PL.batch_valuation(requests, {deal: (m, mean_error(m)) for deal, m in models.items()}, t.centroids, located_pois(t), feature_names(serve_consistent=True))


def _valued(t):
    models = {deal: MO.train_cv(materialize(matrix(t, deal)), feature_names(serve_consistent=True)) for deal in ("sale", "rent")}
    return score_requests(t, valuation_requests(t), models)


query("batch_valuation")(_valued)
query("comparables_valuation")(lambda t: PL.comparables_valuation(t.requests, priced_properties(t), DENSITY_AS_OF))
