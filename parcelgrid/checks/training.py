"""Training sets, folds, encodings and metrics."""
from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.checks.market import PROPS, r
from parcelgrid.checks.registry import query
from parcelgrid.functions.common import round_even
from parcelgrid.operators import training as T
from parcelgrid.sources.collections import join_enrichment

DOCS = """docs AS (SELECT t.doc_id, t.ok, t.pk, t.country, t.property_type, t.listing_type, t.price_eur, t.area_sqm, t.lat, t.lon, t.locality, t.address_raw,
  ok % 9 = 0 AS vat_out, ok % 8 = 0 AS weekly, price_eur > 10000000 OR price_eur < 1 AS odd FROM texts t)"""


def docs(t):
    return t.texts.select(
        "doc_id", "ok", "pk", "country", "property_type", "listing_type", "price_eur", "area_sqm", "lat", "lon", "locality", "address_raw",
        F.when(F.col("ok") % 9 == 0, "excluded").alias("vat_status"),
        F.when(F.col("ok") % 8 == 0, '{"Period": "Weekly"}').when(F.col("ok") % 8 == 1, '[{"Period": "Monthly"}]').alias("raw_data"),
        F.array_compact(F.array(F.when((F.col("price_eur") > 10_000_000) | (F.col("price_eur") < 1), "odd_price"))).alias("suspicious"))


def _reasons(kind, deal, lo, hi, a_lo, a_hi, need_area):
    price = "price_eur * CASE WHEN vat_out THEN CAST(1.2 AS DOUBLE) ELSE 1 END"
    area = "CASE WHEN area_sqm > 1 THEN area_sqm END"
    period = "WHEN weekly THEN 'non_monthly'" if deal == "rent" else ""
    need = f"WHEN {area} IS NULL THEN 'no_area'" if need_area else ""
    dense = f"WHEN {price} / {area} > 30000 OR {price} / {area} < 100 THEN 'price_outlier'" if deal == "sale" else ""
    return f"""CASE WHEN property_type <> '{kind}' THEN 'type' WHEN listing_type <> '{deal}' THEN 'listing' WHEN odd THEN 'suspicious'
      WHEN price_eur IS NULL OR price_eur <= 0 THEN 'no_price' WHEN lat IS NULL OR lon IS NULL THEN 'no_coords' {period}
      WHEN {price} < {lo} OR {price} > {hi} THEN 'price_outlier' WHEN {area} < {a_lo} OR {area} > {a_hi} THEN 'area_outlier' {need} {dense} END"""


SALE = _reasons("apartment", "sale", 50000, 5000000, 15, 500, True)
RENT = _reasons("apartment", "rent", 300, 10000, 15, 500, False)
query("training_filter", f"""
, {DOCS} SELECT doc_id, {SALE} AS sale_reason, {RENT} AS rent_reason, CASE WHEN country = 'BG' THEN concat(locality, ', Sofia') ELSE locality END AS locality FROM docs""",
      ("texts",))(
    lambda t: T.training_filter(docs(t), "apartment", "sale").select("doc_id", F.col("reject_reason").alias("sale_reason"), "locality").join(
        T.training_filter(docs(t), "apartment", "rent").select("doc_id", F.col("reject_reason").alias("rent_reason")), "doc_id"))
query("skip_counts", f", {DOCS} SELECT {SALE} AS reject_reason, count(*) AS n FROM docs GROUP BY 1 HAVING reject_reason IS NOT NULL", ("texts",))(
    lambda t: T.skip_counts(T.training_filter(docs(t), "apartment", "sale")))
query("rent_period_filter", "SELECT doc_id, ok % 8 <> 0 AS monthly FROM texts", ("texts",))(
    lambda t: (lambda d: d.select("doc_id", T.rent_period_filter(d).alias("monthly")))(docs(t)))
query("join_enrichment", """
SELECT l.doc_id, CASE WHEN f.doc_id IS NOT NULL AND ok % 2 = 0 THEN f.quality_tier ELSE 'own' END AS quality_tier,
  CASE WHEN f.doc_id IS NOT NULL AND ok % 2 = 0 THEN f.condition END AS condition FROM listings l LEFT JOIN text_features f USING (doc_id)""", ("text_features",))(
    lambda t: _enriched(t))


def _enriched(t):
    own = t.listings.withColumn("text", F.struct(F.lit(None).cast("long").alias("condition"), F.lit("own").alias("quality_tier")))
    run = t.text_features.join(t.listings.filter("ok % 2 = 0").select("doc_id"), "doc_id").select("doc_id", F.struct("condition", "quality_tier").alias("features"))
    return join_enrichment(own, run).select("doc_id", "text.quality_tier", "text.condition")


# --- Folds and codes ------------------------------------------------------------------------------------
query("spatial_folds", """
SELECT doc_id, CAST(ntile(5) OVER (PARTITION BY locality ORDER BY lat, md5(doc_id)) - 1 AS INT) AS fold FROM listings WHERE lat IS NOT NULL""")(
    lambda t: T.spatial_folds(t.listings.filter("lat IS NOT NULL").select("doc_id", "locality", "lat")).select("doc_id", "fold"))
query("latitude_strips", """
SELECT doc_id, CAST(ntile(5) OVER (ORDER BY lat, md5(doc_id)) - 1 AS INT) AS fold FROM listings WHERE lat IS NOT NULL""")(
    lambda t: T.latitude_strips(t.listings.filter("lat IS NOT NULL").select("doc_id", "lat")).select("doc_id", "fold"))
query("label_codes", "SELECT DISTINCT title AS value, CAST(dense_rank() OVER (ORDER BY title) - 1 AS INT) AS code FROM listings")(
    lambda t: T.label_codes(t.listings, "title"))
query("sale_rent_locality_codes", """
, codes AS (SELECT title AS value, row_number() OVER (ORDER BY title) - 1 AS code FROM (SELECT DISTINCT title FROM listings WHERE listing_type = 'rent'))
SELECT doc_id, COALESCE(code, (SELECT median(code) FROM codes))::DOUBLE AS locality_enc FROM listings LEFT JOIN codes ON title = value WHERE listing_type = 'sale'""")(
    lambda t: T.sale_rent_locality_codes(t.listings.filter("listing_type = 'sale'").select("doc_id", "title"),
                                         T.label_codes(t.listings.filter("listing_type = 'rent'"), "title"), "title").select("doc_id", "locality_enc"))
query("target_encode", f"""
, train AS (SELECT * FROM listings WHERE listing_type = 'sale' AND price_eur IS NOT NULL), g AS (SELECT avg(price_eur) AS m FROM train),
s AS (SELECT title, sum(price_eur) AS s, count(*) AS n FROM train GROUP BY title)
SELECT doc_id, {r('COALESCE((s + 10 * m) / (n + 10), m)', 4)} AS enc FROM listings LEFT JOIN s USING (title), g WHERE listing_type = 'rent'""")(
    lambda t: T.target_encode(t.listings.filter("listing_type = 'sale' AND price_eur IS NOT NULL"), t.listings.filter("listing_type = 'rent'"), "title", "price_eur")
    .select("doc_id", round_even("enc", 4).alias("enc")))


# --- Metrics ---------------------------------------------------------------------------------------------
PRED = """pred AS (SELECT doc_id, property_type, price_eur AS y, CAST(40000 + 2000 * COALESCE(area_sqm, 60) + 1000 * (pk % 40) AS DOUBLE) AS yhat
  FROM listings WHERE listing_type = 'sale' AND price_eur > 1000)"""


def predictions(t):
    return t.listings.filter("listing_type = 'sale' AND price_eur > 1000").select(
        "doc_id", "property_type", F.col("price_eur").alias("y"),
        (F.lit(40000) + F.coalesce("area_sqm", F.lit(60.0)) * 2000 + (F.col("pk") % 40) * 1000).cast("double").alias("yhat"))


query("regression_metrics", f""", {PRED} SELECT property_type, {r('avg(abs(y - yhat))', 2)} AS mae, {r('sqrt(avg(pow(y - yhat, 2)))', 2)} AS rmse,
  {r('1 - avg(pow(y - yhat, 2)) / var_pop(y)', 4)} AS r2, {r('avg(abs(y - yhat) / y) * 100', 2)} AS mape_pct, {r('median(abs(y - yhat))', 2)} AS median_ae, count(*) AS n
FROM pred GROUP BY property_type""")(lambda t: T.regression_metrics(predictions(t), by=["property_type"]))
query("accuracy_buckets", ", " + PRED + " SELECT " + ", ".join(
    r(f"avg(CASE WHEN abs((y - yhat) / y) * 100 <= {k} THEN 1.0::DOUBLE ELSE 0 END) * 100", 1) + f" AS within_{k}pct" for k in (5, 10, 15, 20, 25)) + " FROM pred")(
    lambda t: T.accuracy_buckets(predictions(t)))
COVERED = ("price_eur", "area_sqm", "bedrooms", "lat", "lon", "locality", "property_type", "listing_type", "title", "description", "first_seen", "last_seen", "is_active")
_COV = " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS n, {r(f'count({c}) * 100.0::DOUBLE / count(*)', 1)} AS pct FROM listings"
                          for c in COVERED)
query("feature_coverage", _COV)(
    lambda t: T.feature_coverage(t.listings, list(COVERED)))
query("price_quantiles", f"""SELECT min(price_eur) AS min, {r('quantile_cont(price_eur, 0.05)', 4)} AS p5, median(price_eur) AS median,
  {r('quantile_cont(price_eur, 0.95)', 4)} AS p95, max(price_eur) AS max, count(price_eur) AS n FROM listings""")(
    lambda t: T.price_quantiles(t.listings).withColumns({"p5": round_even("p5", 4), "p95": round_even("p95", 4)}))
query("winsorize_prices", """, b AS (SELECT quantile_cont(price_eur, 0.01) AS lo, quantile_cont(price_eur, 0.99) AS hi FROM listings WHERE listing_type = 'sale')
SELECT doc_id, """ + r("CASE WHEN price_eur IS NOT NULL THEN least(greatest(price_eur, lo), hi) END", 4) + " AS price_eur FROM listings, b WHERE listing_type = 'sale'")(
    lambda t: T.winsorize_prices(t.listings.filter("listing_type = 'sale'")).select("doc_id", round_even("price_eur", 4).alias("price_eur")))
query("normalized_importance", f"""SELECT feature, {r('imp / sum(imp) OVER ()', 3)} AS share FROM (SELECT title AS feature, sum(area_sqm) AS imp FROM listings GROUP BY title HAVING sum(area_sqm) IS NOT NULL)
ORDER BY imp DESC, feature LIMIT 20""")(
    lambda t: T.normalized_importance(t.listings.groupBy(F.col("title").alias("feature")).agg(F.sum("area_sqm").alias("importance")).filter("importance IS NOT NULL")))

# --- Stored sets and models ----------------------------------------------------------------------------------
query("feature_store_join", """SELECT p.id, c.code AS country_code, r.name AS region_name FROM properties p JOIN countries c ON p.country_id = c.id
LEFT JOIN regions r ON p.region_id = r.id""", PROPS)(
    lambda t: T.feature_store_join(t.properties, t.countries, t.regions).select("id", "country_code", "region_name"))
query("read_sql_training", """SELECT p.id, lat, lon, property_type, area_sqm, floor, rooms, price_adjusted_eur, r.name AS region_name FROM properties p LEFT JOIN regions r ON p.region_id = r.id
WHERE p.country_id = 1 AND price_adjusted_eur > 0 AND lat IS NOT NULL AND lon IS NOT NULL AND area_sqm > 0""", PROPS)(
    lambda t: T.read_sql_training(t.properties, t.countries, t.regions, "mt").select(
        "id", "lat", "lon", "property_type", "area_sqm", "floor", "rooms", "price_adjusted_eur", "region_name"))


def artifacts(t):
    """One artifact row per listing: its title is the model, its date the version."""
    kind = F.expr("CASE ok % 4 WHEN 0 THEN 'boosted' WHEN 1 THEN 'second' WHEN 2 THEN 'encoders' ELSE 'meta' END")
    return t.listings.select(F.col("title").alias("model"), F.concat(F.lit("v"), F.date_format("first_seen", "yyyy")).alias("version"), kind.alias("kind"))


query("complete_versions", """, a AS (SELECT title AS model, concat('v', CAST(year(first_seen) AS VARCHAR)) AS version, count(DISTINCT ok % 4) AS k FROM listings GROUP BY ALL)
SELECT model, max(version) AS version FROM a WHERE k = 4 GROUP BY model""")(lambda t: T.complete_versions(artifacts(t)))

