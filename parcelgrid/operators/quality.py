"""Medians, suspicion flags, duplicates, hash de-duplication."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import col, col_or_null, filled, number_at, truthy
from parcelgrid.functions.scalar import dedup_hash, wanted_ad
from parcelgrid.operators.ranking import attach, exact_median


# --- Locality medians ----------------------------------------------------------------

def locality_medians(docs: DataFrame, listing_type: str = "sale", min_n: int = 3,
                     by: Sequence[str] = ("locality",)) -> DataFrame:
    """Exact median price per locality with at least `min_n` priced listings."""
    priced = docs.filter((F.col("listing_type") == listing_type) & (F.col("price_eur") > 100)
                         & filled("locality"))
    return exact_median(priced, by, "price_eur").filter(F.col("n") >= min_n)


# --- Suspicion flags --------------------------------------------------------------------

def title_price_mismatch(title, price) -> Column:
    """`price_title_mismatch:<title price>vs<price>` for the first price in the title
    that is more than ten times off; NULL otherwise."""
    price = col(price)
    texts = F.regexp_extract_all(F.coalesce(col(title), F.lit("")), F.lit(V.TITLE_PRICE_PATTERN), 1)

    def parse(t):
        grouped = t.rlike(r"^[0-9]+(\.[0-9]{3})+$")
        dotted = F.when(grouped, F.regexp_replace(t, r"\.", "")).otherwise(t)
        return F.when(t.contains(","), F.regexp_replace(t, ",", "")).otherwise(dotted).try_cast("double")

    def far_off(p):
        return (F.greatest(p, price) / F.greatest(F.least(p, price), F.lit(1.0))) > 10

    hits = F.filter(F.transform(texts, parse), lambda p: p.isNotNull() & far_off(p))
    first = F.try_element_at(hits, F.lit(1))
    return F.when(first.isNotNull(), F.concat(
        F.lit("price_title_mismatch:"), first.cast("long").cast("string"), F.lit("vs"),
        price.cast("long").cast("string")))


def suspicion_flags(df: DataFrame, median: str = "median") -> Column:
    """Ordered array of reason texts; expects the locality median as a column."""
    price, area = F.col("price_eur"), F.col("area_sqm")
    kind = F.coalesce(F.col("property_type"), F.lit(""))
    deal = F.coalesce(F.col("listing_type"), F.lit("sale"))
    title = F.coalesce(F.col("title"), F.lit(""))
    original = col_or_null(df, "price_original", "string")
    sale = deal == "sale"
    small_ok = kind.isin("parking", "land")
    per_sqm = F.when(area > 0, price / area)
    to_median = F.when((F.col(median) > 0) & (price > 0) & sale & filled("locality"), price / F.col(median))

    level = (F.when(price > 10_000_000, "price_extreme_high")
             .when(price < 1, "price_zero_or_negative")
             .when(sale & (price < 100), "price_placeholder")
             .when(sale & (price < 1000) & ~small_ok, "price_suspiciously_low"))
    sqm = F.when(sale & (per_sqm > 50_000), "price_per_sqm_extreme_high").when(
        sale & (per_sqm < 50) & (kind != "land"), "price_per_sqm_extreme_low")
    outlier = F.when(to_median > 50, "price_locality_outlier_high").when(
        to_median < 0.01, "price_locality_outlier_low")
    on_request = F.when(price.isNull() & filled(original), "price_on_request")
    size = F.when((area < 5) & ~small_ok, "area_too_small").when(
        (area > 50_000) & (kind != "land"), "area_too_large")
    wanted = F.when(wanted_ad("title", col_or_null(df, "is_wanted", "boolean")), "wanted_ad")
    duplicate = F.when(filled(col_or_null(df, "duplicate_of", "string")), "duplicate")
    no_price = F.when(~truthy(price) & ~filled(original), "no_price")
    no_title = F.when(title == "", "no_title")
    unknown = F.when(kind == "other", "type_unknown")
    return F.array_compact(F.array(
        level, title_price_mismatch(title, price), sqm, outlier, on_request, size, wanted,
        duplicate, no_price, no_title, unknown))


def flag_suspicious(df: DataFrame, medians: DataFrame) -> DataFrame:
    """Adds `suspicious`; `medians` holds `median` keyed by locality (and source)."""
    keys = [c for c in medians.columns if c in ("source", "locality")]
    joined = attach(df, medians.select(*keys, "median"), keys)
    return joined.withColumn("suspicious", suspicion_flags(joined)).drop("median")


def flag_counts(df: DataFrame) -> DataFrame:
    """Documents per kind of flag, the text before the colon."""
    return (df.select(F.explode("suspicious").alias("f"))
            .groupBy(F.substring_index("f", ":", 1).alias("flag"))
            .agg(F.count("*").alias("n")))


# --- Duplicates of the same property -----------------------------------------------------

def listing_dedup_key(df: DataFrame, key_chars: int = 100) -> Column:
    """struct(price, area, text) or NULL.  A missing area is a valid part of the key."""
    text = F.regexp_replace(F.coalesce(F.col("description"), F.lit("")), r"^\s+|\s+$", "")
    key = F.struct(F.col("price_eur").alias("k_price"), F.col("area_sqm").alias("k_area"),
                   F.lower(F.substring(text, 1, key_chars)).alias("k_text"))
    return F.when(F.col("price_eur").isNotNull() & (F.length(text) >= 20), key)


def duplicate_groups(df: DataFrame, id_col: str = "doc_id", inserted: str | None = None) -> DataFrame:
    """One row per key held by several listings, with its canonical id."""
    when = F.coalesce(F.col(inserted).cast("string"), F.lit("")) if inserted else F.lit("")
    keyed = df.select(listing_dedup_key(df).alias("k"), F.col(id_col).alias("i"), when.alias("t"))
    return (keyed.filter(F.col("k").isNotNull())
            .groupBy("k.k_price", "k.k_area", "k.k_text")
            .agg(F.min(F.struct("t", "i"))["i"].alias("canonical"), F.count("*").alias("copies"))
            .filter(F.col("copies") > 1))


def mark_duplicates(df: DataFrame, id_col: str = "doc_id", inserted: str | None = None) -> DataFrame:
    """Adds `duplicate_of`, worked out afresh: the canonical id for every other copy.

    The canonical copy comes from a partial aggregate, never from a window, so a
    group holding a third of the table stays spread over all tasks.
    """
    groups = duplicate_groups(df, id_col, inserted).drop("copies")
    key = listing_dedup_key(df)
    keyed = df.drop("duplicate_of").withColumns(
        {"k_price": key["k_price"], "k_area": key["k_area"], "k_text": key["k_text"]})
    joined = attach(keyed, groups, ["k_price", "k_area", "k_text"])
    return joined.withColumn("duplicate_of", F.when(
        F.col("k_text").isNotNull() & (F.col("canonical") != F.col(id_col)), F.col("canonical"))
    ).drop("k_price", "k_area", "k_text", "canonical")


def duplicate_stats(df: DataFrame) -> DataFrame:
    """One row: groups with copies, listings to mark, listings without a key."""
    key = listing_dedup_key(df)
    per_key = (df.select(key["k_price"].alias("k_price"), key["k_area"].alias("k_area"),
                         key["k_text"].alias("k_text"))
               .groupBy("k_price", "k_area", "k_text").agg(F.count("*").alias("c")))
    no_key = F.col("k_text").isNull()
    return per_key.agg(
        F.count_if(~no_key & (F.col("c") > 1)).alias("groups"),
        F.coalesce(F.sum(F.when(~no_key & (F.col("c") > 1), F.col("c") - 1)), F.lit(0)).alias("to_mark"),
        F.coalesce(F.sum(F.when(no_key, F.col("c"))), F.lit(0)).alias("skipped"))


# --- Item hashes ----------------------------------------------------------------------------

def with_dedup_hash(df: DataFrame) -> DataFrame:
    return df.withColumn("dedup_hash", dedup_hash(df))


def flag_seen(df: DataFrame, order_cols: Sequence[str], key: str = "dedup_hash") -> DataFrame:
    """`is_duplicate` is false for the first arrival of a hash, true for later ones."""
    first = df.groupBy(key).agg(F.min(F.struct(*order_cols)).alias("__first"))
    return (attach(df, first, [key])
            .withColumn("is_duplicate", F.struct(*order_cols) != F.col("__first")).drop("__first"))


def upsert_relational(target: DataFrame, batch: DataFrame, now, order_cols: Sequence[str],
                      countries: DataFrame | None = None) -> DataFrame:
    """Match by `dedup_hash`: a known row gets price, adjusted price, activity and
    times; an unknown one is inserted.  Items of unknown countries are skipped."""
    items = batch
    if countries is not None:
        codes = countries.select(F.upper("code").alias("__code"), F.col("id").alias("country_id"))
        items = (items.drop("country_id")
                 .join(codes, F.upper(items["country_code"]) == F.col("__code"), "inner").drop("__code"))
    now = F.lit(now).cast("timestamp")
    body = [c for c in target.columns if c in items.columns and c != "dedup_hash"]
    arrival = F.struct(*order_cols)
    per_hash = items.groupBy("dedup_hash").agg(
        F.min_by(F.struct(*body), arrival).alias("first"),
        F.max_by(F.struct("price_eur", "price_adjusted_eur"), arrival).alias("last"))
    t, b = target.alias("t"), per_hash.alias("b")
    joined = t.join(b, F.col("t.dedup_hash") == F.col("b.dedup_hash"), "full_outer")
    known, touched = F.col("t.dedup_hash").isNotNull(), F.col("b.dedup_hash").isNotNull()
    out = []
    for c in target.columns:
        old = F.col(f"t.{c}")
        if c in ("price_eur", "price_adjusted_eur"):
            new = F.when(touched, F.col(f"b.last.{c}")).otherwise(old)
        elif c in ("scraped_at", "updated_at"):
            new = F.when(touched, now).otherwise(old)
        elif c == "created_at":
            new = F.when(known, old).otherwise(now)
        elif c == "is_active":
            new = F.when(touched, F.lit(True)).otherwise(old)
        elif c == "dedup_hash":
            new = F.coalesce(old, F.col("b.dedup_hash"))
        else:
            new = F.when(known, old).otherwise(F.col(f"b.first.{c}")) if c in body else old
        out.append(new.alias(c))
    return joined.select(*out)


def unique_urls(df: DataFrame, order_cols: Sequence[str], url: str = "url") -> DataFrame:
    """First URL of each listing id found in the URL text."""
    ids = df.withColumn("listing_id", number_at(url, r"obiava-(\w+)"))
    rest = [c for c in df.columns]
    return (ids.filter(F.col("listing_id").isNotNull()).groupBy("listing_id")
            .agg(F.min_by(F.struct(*rest), F.struct(*order_cols)).alias("r"))
            .select("listing_id", "r.*"))


def cross_source_ids(pages: DataFrame, docs: DataFrame, key: str = "listing_id") -> DataFrame:
    """How many ids are cached as pages, stored as documents, or both."""
    sides = (pages.select(key, F.lit(1).alias("p"), F.lit(0).alias("d"))
             .unionByName(docs.select(key, F.lit(0).alias("p"), F.lit(1).alias("d")))
             .groupBy(key).agg(F.max("p").alias("p"), F.max("d").alias("d")))
    return sides.agg(F.count_if((F.col("p") == 1) & (F.col("d") == 1)).alias("in_both"),
                     F.count_if((F.col("p") == 1) & (F.col("d") == 0)).alias("only_pages"),
                     F.count_if((F.col("p") == 0) & (F.col("d") == 1)).alias("only_docs"))
