"""Medians, flags, duplicates, hashes, history and upserts."""
from __future__ import annotations

from pyspark.sql import functions as F

from parcelgrid.checks.registry import AS_OF, query
from parcelgrid.checks.market import r
from parcelgrid.functions.common import round_even
from parcelgrid.operators import history as H
from parcelgrid.operators import quality as Q

MEDIANS = ("med AS (SELECT locality, median(price_eur) AS median, count(*) AS n FROM listings WHERE listing_type = 'sale' AND price_eur > 100 "
           "GROUP BY locality HAVING count(*) >= 3)")
query("locality_medians", f", {MEDIANS} SELECT * FROM med")(lambda t: Q.locality_medians(t.listings))

# Titles that carry a price, to exercise the title check on whole tables.
TITLED = """titled AS (SELECT l.* EXCLUDE (title), CASE WHEN ok % 12 = 0 THEN NULL WHEN ok % 7 = 0 THEN concat(title, ' 480.000 €')
  WHEN ok % 7 = 1 THEN concat(title, ' 1,250,000 EUR or 99 eur') ELSE title END AS title FROM listings l)"""


def titled(t):
    ok, title = F.col("ok"), F.col("title")
    return t.listings.withColumn("title", F.when(ok % 12 == 0, None).when(ok % 7 == 0, F.concat(title, F.lit(" 480.000 €")))
                                 .when(ok % 7 == 1, F.concat(title, F.lit(" 1,250,000 EUR or 99 eur"))).otherwise(title))


_MIS = """CASE WHEN ok % 12 = 0 OR price_eur IS NULL THEN NULL
  WHEN ok % 7 = 0 AND greatest(480000, price_eur) / greatest(least(480000, price_eur), 1) > 10 THEN concat('price_title_mismatch:480000vs', CAST(CAST(price_eur AS BIGINT) AS VARCHAR))
  WHEN ok % 7 = 1 AND greatest(1250000, price_eur) / greatest(least(1250000, price_eur), 1) > 10 THEN concat('price_title_mismatch:1250000vs', CAST(CAST(price_eur AS BIGINT) AS VARCHAR))
  WHEN ok % 7 = 1 AND greatest(99, price_eur) / greatest(least(99, price_eur), 1) > 10 THEN concat('price_title_mismatch:99vs', CAST(CAST(price_eur AS BIGINT) AS VARCHAR)) END"""
query("title_price_mismatch", f", {TITLED} SELECT doc_id, {_MIS} AS value FROM titled")(
    lambda t: titled(t).select("doc_id", Q.title_price_mismatch("title", "price_eur").alias("value")))
FLAGGED = f"""{TITLED}, {MEDIANS}, flagged AS (SELECT t.*, concat_ws(',',
  CASE WHEN price_eur > 10000000 THEN 'price_extreme_high' WHEN price_eur < 1 THEN 'price_zero_or_negative' WHEN listing_type = 'sale' AND price_eur < 100 THEN 'price_placeholder'
       WHEN listing_type = 'sale' AND price_eur < 1000 AND property_type NOT IN ('parking', 'land') THEN 'price_suspiciously_low' END, {_MIS},
  CASE WHEN listing_type = 'sale' AND area_sqm > 0 AND price_eur / area_sqm > 50000 THEN 'price_per_sqm_extreme_high'
       WHEN listing_type = 'sale' AND area_sqm > 0 AND price_eur / area_sqm < 50 AND property_type <> 'land' THEN 'price_per_sqm_extreme_low' END,
  CASE WHEN listing_type = 'sale' AND price_eur > 0 AND price_eur / median > 50 THEN 'price_locality_outlier_high'
       WHEN listing_type = 'sale' AND price_eur > 0 AND price_eur / median < 0.01 THEN 'price_locality_outlier_low' END,
  CASE WHEN area_sqm < 5 AND property_type NOT IN ('parking', 'land') THEN 'area_too_small' WHEN area_sqm > 50000 AND property_type <> 'land' THEN 'area_too_large' END,
  CASE WHEN lower(COALESCE(title, '')) LIKE '%wanted%' THEN 'wanted_ad' END, CASE WHEN price_eur IS NULL THEN 'no_price' END,
  CASE WHEN title IS NULL THEN 'no_title' END, CASE WHEN property_type = 'other' THEN 'type_unknown' END) AS flags
  FROM titled t LEFT JOIN med USING (locality))"""
query("flag_suspicious", f", {FLAGGED} SELECT doc_id, flags FROM flagged")(
    lambda t: Q.flag_suspicious(titled(t), Q.locality_medians(t.listings)).select("doc_id", F.concat_ws(",", "suspicious").alias("flags")))
query("flag_counts", f""", {FLAGGED} SELECT split_part(f, ':', 1) AS flag, count(*) AS n
FROM (SELECT unnest(string_split(flags, ',')) AS f FROM flagged WHERE flags <> '') GROUP BY 1""")(
    lambda t: Q.flag_counts(Q.flag_suspicious(titled(t), Q.locality_medians(t.listings))))

# --- Duplicates --------------------------------------------------------------------------------------
KEYED = """keyed AS (SELECT doc_id, price_eur AS kp, area_sqm AS ka, lower(substr(trim(description), 1, 100)) AS kt,
  price_eur IS NOT NULL AND length(trim(description)) >= 20 AS has_key FROM listings)"""
query("listing_dedup_key", f", {KEYED} SELECT doc_id, CASE WHEN has_key THEN kp END AS k_price, CASE WHEN has_key THEN ka END AS k_area, CASE WHEN has_key THEN kt END AS k_text FROM keyed")(
    lambda t: (lambda d: d.select("doc_id", Q.listing_dedup_key(d).alias("k")).select("doc_id", "k.*"))(t.listings))
query("mark_duplicates", f""", {KEYED} SELECT doc_id, CASE WHEN has_key THEN nullif(first_id, doc_id) END AS duplicate_of FROM
  (SELECT *, min(doc_id) OVER (PARTITION BY has_key, kp, ka, kt) AS first_id FROM keyed)""")(
    lambda t: Q.mark_duplicates(t.listings).select("doc_id", "duplicate_of"))
query("duplicate_stats", f""", {KEYED}, g AS (SELECT count(*) AS c FROM keyed WHERE has_key GROUP BY kp, ka, kt)
SELECT count(*) FILTER (c > 1) AS "groups", CAST(sum(CASE WHEN c > 1 THEN c - 1 ELSE 0 END) AS BIGINT) AS to_mark,
  (SELECT count(*) FROM keyed WHERE NOT has_key) AS skipped FROM g""")(lambda t: Q.duplicate_stats(t.listings))
query("flag_seen", "SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 AS is_duplicate FROM events", ())(
    lambda t: Q.flag_seen(t.events.withColumn("dedup_hash", F.concat_ws(":", "user_id", "event_type")), ["ts", "event_id"]).select("event_id", "is_duplicate"))


def _items(df, order):
    return df.select(F.col("title").alias("dedup_hash"), "locality", "price_eur", (F.col("price_eur") * 2).alias("price_adjusted_eur"), "is_active",
                     F.col("first_seen").cast("timestamp").alias("created_at"), F.col("last_seen").cast("timestamp").alias("scraped_at"),
                     F.when(F.col("ok") % 6 == 0, "XX").otherwise(F.col("country")).alias("country_code"), F.col("doc_id").alias(order))


def _upsert_relational(t):
    target = (_items(t.batch1.filter("pk % 2 = 0"), "i").groupBy("dedup_hash").agg(F.min_by(F.struct(
        "locality", "price_eur", "price_adjusted_eur", "is_active", "created_at", "scraped_at"), "i").alias("r")).select("dedup_hash", "r.*"))
    out = Q.upsert_relational(target, _items(t.batch2, "i"), AS_OF, ["i"], t.countries)
    return out.select("dedup_hash", "locality", "price_eur", "price_adjusted_eur", "is_active", F.col("created_at").cast("timestamp_ntz").alias("created_at"),
                      F.col("scraped_at").cast("timestamp_ntz").alias("scraped_at"))


query("upsert_relational", f"""
, tgt AS (SELECT title AS h, arg_min(locality, doc_id) AS locality, arg_min_null(price_eur, doc_id) AS price_eur, arg_min_null(price_eur * 2, doc_id) AS adj,
  arg_min(is_active, doc_id) AS is_active, arg_min(first_seen, doc_id) AS created_at, arg_min(last_seen, doc_id) AS scraped_at FROM batch1 WHERE pk % 2 = 0 GROUP BY title),
bat AS (SELECT title AS h, arg_min(locality, doc_id) AS locality, arg_max_null(price_eur, doc_id) AS price_eur, arg_max_null(price_eur * 2, doc_id) AS adj
  FROM batch2 WHERE ok % 6 <> 0 GROUP BY title)
SELECT COALESCE(tgt.h, bat.h) AS dedup_hash, CASE WHEN tgt.h IS NULL THEN bat.locality ELSE tgt.locality END AS locality,
  CASE WHEN bat.h IS NULL THEN tgt.price_eur ELSE bat.price_eur END AS price_eur, CASE WHEN bat.h IS NULL THEN tgt.adj ELSE bat.adj END AS price_adjusted_eur,
  CASE WHEN bat.h IS NULL THEN is_active ELSE TRUE END AS is_active, CASE WHEN tgt.h IS NULL THEN TIMESTAMP '{AS_OF}' ELSE created_at END AS created_at,
  CASE WHEN bat.h IS NULL THEN scraped_at ELSE TIMESTAMP '{AS_OF}' END AS scraped_at
FROM tgt FULL JOIN bat ON tgt.h = bat.h""", ("batch1", "batch2"))(_upsert_relational)
query("unique_urls", """
SELECT regexp_extract(url, 'obiava-(\\w+)', 1) AS listing_id, min(doc_id) AS doc_id FROM texts WHERE url LIKE '%obiava-%' GROUP BY 1""", ("texts",))(
    lambda t: Q.unique_urls(t.texts.select("doc_id", "url"), ["doc_id"]).select("listing_id", "doc_id"))
query("cross_source_ids", """
SELECT count(*) FILTER (p AND d) AS in_both, count(*) FILTER (p AND NOT d) AS only_pages, count(*) FILTER (d AND NOT p) AS only_docs
FROM (SELECT doc_id, bool_or(ok % 10 <> 3) AS p, bool_or(ok % 10 <> 7) AS d FROM listings GROUP BY doc_id)""")(
    lambda t: Q.cross_source_ids(t.batch1.select(F.col("doc_id").alias("listing_id")), t.batch2.select(F.col("doc_id").alias("listing_id"))))

# --- Change tracking -------------------------------------------------------------------------------------
FIELDS = ("property_type", "listing_type", "locality", "price_eur", "area_sqm", "bedrooms", "lat", "lon", "title", "description", "is_active")
CHANGED = """chg AS (SELECT n.doc_id, n.ok, n.last_seen AS seen, o.price_eur AS old_price, n.price_eur AS new_price,
  COALESCE(n.price_eur IS NOT NULL AND (o.price_eur IS NULL OR abs(o.price_eur - n.price_eur) >= 0.01), FALSE) AS c_price,
  trim(o.title) <> trim(n.title) AS c_title, o.is_active <> n.is_active AS c_active, n.is_active AS now_active
  FROM batch2 n JOIN batch1 o USING (doc_id)),
ev AS (SELECT *, CASE WHEN c_active AND NOT now_active THEN 'deactivated' WHEN c_active THEN 'reactivated' WHEN c_price AND NOT c_title THEN 'price_change'
  WHEN c_price THEN 'price_and_content_change' WHEN c_title THEN 'content_change' END AS event FROM chg WHERE c_price OR c_title OR c_active)"""


def _pairs(t):
    old = t.batch1.select("doc_id", F.struct(*FIELDS).alias("old"))
    return t.batch2.select("doc_id", F.struct(*FIELDS).alias("new")).join(old, "doc_id")


query("diff_fields", f""", {CHANGED} SELECT doc_id, concat_ws(',', CASE WHEN c_active THEN 'is_active' END, CASE WHEN c_price THEN 'price_eur' END,
  CASE WHEN c_title THEN 'title' END) AS fields FROM chg""", ("batch1", "batch2"))(
    lambda t: (lambda d: d.select("doc_id", F.concat_ws(",", F.array_sort(F.map_keys(H.diff_fields(d, "old", "new")))).alias("fields")))(_pairs(t)))
query("classify_change_event", f", {CHANGED} SELECT doc_id, event FROM ev", ("batch1", "batch2"))(
    lambda t: (lambda d: d.withColumn("c", H.diff_fields(d, "old", "new")).filter(F.size("c") > 0).select("doc_id", H.classify_change_event("c").alias("event")))(_pairs(t)))


def scrape(df, source_time="last_seen"):
    return df.select("doc_id", "source", "country", F.col(source_time).cast("timestamp").alias("scraped_at"), *FIELDS)


def two_scrapes(t):
    first = H.upsert_listings(None, scrape(t.batch1))
    return first, H.upsert_listings(first.state, scrape(t.batch2))


query("upsert_listings", """
SELECT COALESCE(n.doc_id, o.doc_id) AS doc_id, COALESCE(o.last_seen, n.last_seen) AS first_seen, COALESCE(n.last_seen, o.last_seen) AS last_seen,
  COALESCE(n.price_eur, o.price_eur) AS price_eur, COALESCE(n.area_sqm, o.area_sqm) AS area_sqm, COALESCE(n.title, o.title) AS title,
  COALESCE(n.is_active, o.is_active) AS is_active FROM batch1 o FULL JOIN batch2 n ON o.doc_id = n.doc_id""", ("batch1", "batch2"))(
    lambda t: two_scrapes(t)[1].state.select(
        "doc_id", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"),
        "price_eur", "area_sqm", "title", "is_active"))
EVENTS = f"""{CHANGED}, events_all AS (SELECT doc_id, last_seen AS date, 'created' AS event FROM batch1
  UNION ALL SELECT doc_id, last_seen, 'created' FROM batch2 WHERE doc_id NOT IN (SELECT doc_id FROM batch1)
  UNION ALL SELECT doc_id, seen, event FROM ev)"""


def all_events(t):
    first, second = two_scrapes(t)
    return first.events.unionByName(second.events)


query("upsert_events", f", {EVENTS} SELECT doc_id, date, event FROM events_all", ("batch1", "batch2"))(
    lambda t: all_events(t).select("doc_id", F.col("date").cast("timestamp_ntz").alias("date"), "event"))
query("event_counts", f", {EVENTS} SELECT source, event, count(*) AS n FROM events_all JOIN listings USING (doc_id) GROUP BY source, event", ("listings", "batch1", "batch2"))(
    lambda t: H.event_counts(all_events(t), "source"))
query("run_counters", """
SELECT 'r1' AS run_id, 'daily' AS spider_name, 'MT' AS country_code, count(*) AS items_scraped, count(*) FILTER (o.doc_id IS NULL) AS items_new,
  count(*) FILTER (o.doc_id IS NOT NULL) AS items_updated, 0::BIGINT AS errors_count, 'finished' AS status
FROM batch2 n LEFT JOIN (SELECT DISTINCT doc_id FROM batch1) o ON n.doc_id = o.doc_id""", ("batch1", "batch2"))(
    lambda t: H.run_counters(two_scrapes(t)[1].counts, "r1", "daily", "MT", AS_OF, AS_OF).drop("started_at", "finished_at"))
query("price_changes", f""", {CHANGED} SELECT doc_id, locality, property_type, old_price AS old, new_price AS new, {r('pct', 6)} AS pct, seen AS date FROM
  (SELECT chg.*, (new_price - old_price) / old_price * 100 AS pct FROM chg WHERE c_price AND old_price <> 0 AND new_price <> 0 AND new_price < old_price)
  JOIN listings USING (doc_id) ORDER BY (new_price - old_price) / old_price, doc_id LIMIT 30""", ("listings", "batch1", "batch2"))(
    lambda t: H.price_changes(all_events(t), t.listings).withColumns(
        {"pct": round_even("pct", 6), "date": F.col("date").cast("timestamp_ntz")}))
query("longest_listed", f"""
SELECT doc_id, locality, COALESCE(price_eur, 0) AS price_eur, property_type,
  CAST(floor((epoch(TIMESTAMP '{AS_OF}') - epoch(date_trunc('second', first_seen))) / 86400) AS INT) AS days, first_seen
FROM listings ORDER BY days DESC, doc_id LIMIT 30""")(lambda t: H.longest_listed(t.listings, AS_OF))
query("property_history", f""", {CHANGED}, pick AS (SELECT min(doc_id) AS id FROM ev WHERE c_price AND c_title)
SELECT last_seen AS date, 'created' AS event, NULL AS field, NULL AS old, NULL AS new FROM batch1, pick WHERE doc_id = id
UNION ALL SELECT seen, event, 'price_eur', concat(CAST(CAST(old_price AS BIGINT) AS VARCHAR), '.0'), concat(CAST(CAST(new_price AS BIGINT) AS VARCHAR), '.0') FROM ev, pick WHERE doc_id = id
UNION ALL SELECT seen, event, 'is_active', '1', '0' FROM ev, pick WHERE doc_id = id AND c_active
UNION ALL SELECT seen, event, 'title', b1.title, b2.title FROM ev JOIN batch1 b1 USING (doc_id) JOIN batch2 b2 USING (doc_id), pick WHERE doc_id = id""", ("batch1", "batch2"))(
    lambda t: _history(t))


def _history(t):
    events = all_events(t)
    both = events.filter(F.map_contains_key("changes", "price_eur") & F.map_contains_key("changes", "title"))
    out = H.property_history(events, both.agg(F.min("doc_id")).scalar())
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


query("recent_runs", """
SELECT source AS spider_name, CAST(first_seen AS DATE) AS day, count(*) AS items FROM listings GROUP BY 1, 2 ORDER BY day DESC, spider_name DESC LIMIT 10""")(
    lambda t: H.recent_runs(t.listings.groupBy(F.col("source").alias("spider_name"), F.to_date("first_seen").alias("day")).agg(F.count("*").alias("items"))
                            .withColumns({"started_at": F.col("day").cast("timestamp"), "run_id": F.col("spider_name")})).drop("started_at", "run_id"))
