"""Scalar cleaning and normalisation as Column expressions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import (
    col, contains_any, filled, first_match, lookup, map_lookup, null_if_empty,
    number_at, round_even, truthy,
)


# --- Text to numbers -----------------------------------------------------------

def parse_price_text(text) -> Column:
    """Digits of a price text; a dot group of three digits is a thousands mark."""
    kept = F.regexp_replace(F.regexp_replace(col(text), r"[^0-9.,]", ""), ",", "")
    dots = F.length(kept) - F.length(F.regexp_replace(kept, r"\.", ""))
    thousands = (dots > 1) | ((dots == 1) & kept.rlike(r"\.[0-9]{3}$"))
    plain = F.when(thousands, F.regexp_replace(kept, r"\.", "")).otherwise(kept)
    return plain.try_cast("double")


def parse_area_text(text) -> Column:
    found = number_at(text, r"(?i)(\d+(?:[.,]\d+)?)\s*(?:m²|m2|sq\.?\s*m)")
    return F.regexp_replace(found, ",", ".").try_cast("double")


def amount_before(text, mark: str) -> Column:
    found = number_at(text, r"([\d\s]+(?:[.,]\d+)?)\s*" + mark)
    return F.regexp_replace(F.regexp_replace(found, r"\s", ""), ",", ".").try_cast("double")


def parse_eur_bgn_prices(text) -> Column:
    return F.struct(amount_before(text, "€").alias("eur"),
                    amount_before(text, "лв").alias("bgn"))


# --- Types, rooms, condition, tax ------------------------------------------------

def map_property_type(value, vocabulary: str) -> Column:
    """Canonical type; `vocabulary` is `api`, `classified` or `cyrillic`."""
    value = col(value)
    if vocabulary == "api":
        hit = map_lookup(V.API_PROPERTY_TYPES, value)
    elif vocabulary == "classified":
        hit = map_lookup(V.CLASSIFIED_PROPERTY_TYPES, F.lower(value))
    elif vocabulary == "cyrillic":
        hit = first_match(F.lower(value), V.CYRILLIC_PROPERTY_TYPES.items())
    else:
        raise ValueError(f"unknown vocabulary {vocabulary!r}")
    return F.coalesce(hit, F.lit("other"))


def detect_rooms(title) -> Column:
    lowered = F.lower(col(title))
    digit = number_at(lowered, r"(\d)-стаен").cast("int")
    return F.coalesce(digit, first_match(lowered, V.ROOM_WORDS.items()))


def map_condition(text) -> Column:
    return first_match(F.lower(col(text)), V.CONDITION_WORDS)


def detect_vat_status(text) -> Column:
    text = col(text)
    return (F.when(text.contains(V.VAT_EXCLUDED_PHRASE), "excluded")
            .when(text.contains(V.VAT_INCLUDED_PHRASE), "included")
            .otherwise("unknown"))


# --- Money -----------------------------------------------------------------------

def convert_currency(price, currency) -> Column:
    """struct(price, currency) with lev amounts turned into euro."""
    price, currency = col(price), col(currency)
    is_lev = F.coalesce(currency == "BGN", F.lit(False))
    euro = round_even(price * F.lit(1 / V.BGN_PER_EUR), 2)
    return F.struct(F.when(is_lev, euro).otherwise(price).alias("price"),
                    F.when(is_lev, F.lit("EUR")).otherwise(currency).alias("currency"))


def adjusted_price(price, country, price_type=None, factors=None) -> Column:
    """Asking price times the country factor; other price kinds stay as they are."""
    price = col(price)
    factors = V.ADJUSTMENT_FACTORS if factors is None else factors
    kind = F.coalesce(col(price_type), F.lit("asking")) if price_type is not None else F.lit("asking")
    factor = F.coalesce(lookup(factors, country), F.lit(V.DEFAULT_ADJUSTMENT))
    return F.when(truthy(price),
                  F.when(kind == "asking", round_even(price * factor, 2)).otherwise(price))


def adjust_price(df: DataFrame, factors=None, price="price", country="country_code",
                 price_type="price_type") -> DataFrame:
    kind = price_type if price_type in df.columns else None
    return df.withColumn("price_adjusted", adjusted_price(price, country, kind, factors))


def normalize_vat_price(price, vat_status) -> Column:
    price = col(price)
    return F.when(col(vat_status) == "excluded", price * F.lit(V.VAT_RATE)).otherwise(price)


def price_per_sqm(price, area) -> Column:
    price, area = col(price), col(area)
    return F.when(truthy(price) & (area > 0), round_even(price / area, 2))


# --- Country, city ---------------------------------------------------------------

def infer_country(source) -> Column:
    source = col(source)
    out = F.when(source.startswith("mt_"), "MT")
    for prefix, code in (("bg_", "BG"), ("cy_", "CY"), ("hr_", "HR")):
        out = out.when(source.startswith(prefix), code)
    return out.otherwise("")


def detect_country_from_coords(lat, lon) -> Column:
    lat, lon = col(lat), col(lon)

    def inside(code):
        lo_lat, hi_lat, lo_lon, hi_lon = V.COUNTRY_BOXES[code]
        return (lat > lo_lat) & (lat < hi_lat) & (lon > lo_lon) & (lon < hi_lon)

    return F.when(inside("MT"), "MT").when(inside("BG"), "BG").otherwise("MT")


def last_part(text) -> Column:
    """Text after the last comma, trimmed; the whole text when there is none."""
    text = col(text)
    return (F.when(text.contains(","), F.trim(F.element_at(F.split(text, ","), -1)))
            .otherwise(text))


city_of = last_part


def combine_city_locality(locality, address, country) -> Column:
    locality, address = col(locality), col(address)
    combined = F.concat(F.coalesce(locality, F.lit("")), F.lit(", "), last_part(address))
    return (F.when((col(country) == "BG") & address.contains(","), combined)
            .otherwise(locality))


# --- Dates -----------------------------------------------------------------------

def parse_listing_date(text) -> Column:
    """ISO text, or day, Bulgarian month word, year.  A zone in the text is ignored."""
    text = col(text)
    looks_iso = text.rlike(r"^[0-9]{4}-")
    without_zone = F.regexp_replace(F.regexp_replace(text, "T", " "),
                                    r"(Z|[+-][0-9]{2}:?[0-9]{2})$", "")
    iso = F.when(looks_iso, F.try_to_timestamp(without_zone))
    pattern = r"^(\d{1,2})\s+([\p{L}\w]+),?\s*(\d{4})"
    day, word, year = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    month = lookup(V.BG_MONTHS, F.lower(word))
    spelled = F.when(month.isNotNull(), F.try_to_timestamp(
        F.concat(year, F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"),
                 F.lpad(day, 2, "0")), F.lit("yyyy-MM-dd")))
    return F.coalesce(iso, spelled)


def listing_time_from_url(url) -> Column:
    seconds = number_at(url, V.URL_TIME_PATTERN).cast("long")
    return F.when((seconds > V.URL_TIME_MIN) & (seconds < V.URL_TIME_MAX),
                  F.timestamp_seconds(seconds))


def listing_age_days(ts, as_of) -> Column:
    seconds = (F.unix_timestamp(F.lit(as_of).cast("timestamp"))
               - F.unix_timestamp(col(ts).cast("timestamp")))
    return F.floor(seconds / F.lit(86400)).cast("int")


def listing_year(ts) -> Column:
    ts = col(ts)
    return F.year(ts) + F.month(ts) / F.lit(12.0)


# --- Model-side scalars -----------------------------------------------------------

def area_log(area) -> Column:
    area = col(area)
    return F.when(area > 0, F.log(area))


def clean_area(area) -> Column:
    """One square metre or less stands for "not given"."""
    area = col(area)
    return F.when(area > 1.0, area)


def override_area(area, text_area) -> Column:
    text_area = col(text_area)
    return F.when(text_area > 10, text_area.cast("double")).otherwise(col(area))


def listing_score(score) -> Column:
    score = col(score)
    return F.when(score > 0, score.cast("double"))


def condition_to_score(form_condition, text_condition) -> Column:
    return F.coalesce(col(text_condition).cast("int"),
                      lookup(V.CONDITION_SCORES, form_condition))


def label_confidence(score) -> Column:
    score = col(score)
    return F.when(score >= 75, "High").when(score >= 50, "Moderate").otherwise("Low")


def is_gozo(lat) -> Column:
    return F.coalesce(col(lat) > 36.0, F.lit(False))


def wanted_ad(title, is_wanted=None) -> Column:
    lowered = F.lower(F.coalesce(col(title), F.lit("")))
    by_title = contains_any(lowered, V.WANTED_WORDS) | lowered.rlike(V.WANTED_CYRILLIC_PATTERN)
    if is_wanted is None:
        return by_title
    return F.coalesce(col(is_wanted).cast("boolean"), F.lit(False)) | by_title


def locality_from_geocode(payload) -> Column:
    """struct(locality, confidence) out of a geocoder payload in JSON text."""
    payload = col(payload)
    names = [null_if_empty(F.get_json_object(payload, f"$.address.{k}"))
             for k in ("city", "town", "village", "municipality")]
    importance = F.get_json_object(payload, "$.importance").try_cast("double")
    return F.struct(
        F.coalesce(*names).alias("locality"),
        F.when(importance > 0.5, 1.0).otherwise(0.7).alias("confidence"))


# --- Cleaning of scraped items ------------------------------------------------------

def clean_item(df: DataFrame) -> DataFrame:
    """Drop items without a price and tidy currency, address, type, area and floor."""
    out = df.filter(truthy("price"))
    money = convert_currency("price", "price_currency")
    cleaned = {"price": money["price"], "price_currency": money["currency"]}
    if "address_raw" in df.columns:
        spaced = F.trim(F.regexp_replace(F.col("address_raw"), r"\s+", " "))
        cleaned["address_raw"] = F.regexp_replace(spaced, r"\s*,\s*", ", ")
    if "property_type" in df.columns:
        cleaned["property_type"] = F.trim(F.lower(F.col("property_type")))
    if "area_sqm" in df.columns:
        area = F.col("area_sqm")
        cleaned["area_sqm"] = F.when((area == 0) | area.between(5, 10000), area)
    if "floor" in df.columns:
        cleaned["floor"] = F.when(F.col("floor").between(-5, 100), F.col("floor"))
    return out.withColumns(cleaned)


# --- Hash key of an item ----------------------------------------------------------------

def float_text(value) -> Column:
    """Decimal text of a double as Python prints it (`100.0`, not `1.0E7`)."""
    value = col(value).cast("double")
    whole = (F.rint(value) == value) & (F.abs(value) < 1e15)
    text = F.when(whole, F.concat(value.cast("decimal(20,0)").cast("string"), F.lit(".0")))
    return F.coalesce(text.otherwise(value.cast("string")), F.lit(""))


def dedup_hash(df: DataFrame) -> Column:
    by_id = F.concat_ws(":", F.col("source"), F.col("external_id"))
    fallback = F.concat_ws(
        "|", F.trim(F.lower(F.coalesce(F.col("address_raw"), F.lit("")))),
        float_text("price"), F.coalesce(F.col("property_type"), F.lit("")),
        float_text("area_sqm"))
    key = F.when(filled("source") & filled("external_id"), by_id).otherwise(fallback)
    return F.substring(F.sha2(key, 256), 1, 16)
