"""Market statistics, browsing, search and other read queries."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid.functions.common import col_or_null, filled, round_even, truthy
from parcelgrid.functions.scalar import price_per_sqm
from parcelgrid.operators.ranking import dense_positions
from parcelgrid.session import fresh_path


# --- Summaries -----------------------------------------------------------------------------

def list_collections(docs: DataFrame) -> DataFrame:
    return docs.filter(~F.col("source").startswith("_")).select("source").distinct()


def collection_summary(docs: DataFrame) -> DataFrame:
    """Per source: documents, and how many have each kind of content."""
    images = col_or_null(docs, "image_urls", "array<string>")
    priced = F.when(truthy("price_eur"), F.col("price_eur"))
    return docs.groupBy("source").agg(
        F.count("*").alias("n"),
        F.count(priced).alias("n_price"),
        F.count_if(truthy("lat")).alias("n_coords"),
        F.count_if(truthy("area_sqm")).alias("n_area"),
        F.count_if(filled("description")).alias("n_description"),
        F.count_if(F.coalesce(F.size(images) > 0, F.lit(False))).alias("n_images"),
        F.count_if(filled("locality")).alias("n_locality"),
        F.coalesce(F.avg(priced), F.lit(0.0)).alias("avg_price"))


def price_stats() -> list[Column]:
    return [F.count("*").alias("n"), F.avg("price_eur").alias("avg_price"),
            F.min("price_eur").alias("min_price"), F.max("price_eur").alias("max_price")]


def country_price_stats(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("price_eur") > 0).groupBy("country").agg(*price_stats())


def market_stats(docs: DataFrame, top_localities: int = 30) -> DataFrame:
    """Price figures by locality (largest only), type and country, in one pass."""
    named = docs.filter(F.col("price_eur") > 0).select(
        F.coalesce(F.when(filled("locality"), F.col("locality")), F.lit("Unknown")).alias("locality"),
        F.coalesce(F.when(filled("property_type"), F.col("property_type")), F.lit("unknown")).alias("property_type"),
        F.coalesce(F.when(filled("country"), F.col("country")), F.lit("?")).alias("country"), "price_eur")
    keys = ["locality", "property_type", "country"]
    sets = (named.groupingSets([[F.col(k)] for k in keys], *[F.col(k) for k in keys])
            .agg(F.grouping_id().alias("gid"), *price_stats()))
    by = F.when(F.col("gid") == 3, "locality").when(F.col("gid") == 5, "property_type").otherwise("country")
    rows = sets.select(by.alias("by"), F.coalesce(*keys).alias("name"), "n", "avg_price", "min_price", "max_price")
    top = rows.filter(F.col("by") == "locality").orderBy(F.desc("n"), "name").limit(top_localities)
    return top.unionByName(rows.filter(F.col("by") != "locality"))


def adjusted_stats(region_filter: Column | None = None) -> list[Column]:
    price = F.col("price_adjusted_eur")
    per_sqm = price / F.when(F.col("area_sqm") != 0, F.col("area_sqm"))
    return [F.count("*").alias("total_properties"), round_even(F.avg(price), 2).alias("avg_price_eur"),
            round_even(F.avg(per_sqm), 2).alias("avg_price_per_sqm"),
            F.min(price).alias("min_price_eur"), F.max(price).alias("max_price_eur")]


def active_priced(properties: DataFrame) -> DataFrame:
    return properties.filter(F.col("is_active") & F.col("price_adjusted_eur").isNotNull())


def api_market_stats(properties: DataFrame, countries: DataFrame, code: str, region: str | None = None,
                     regions: DataFrame | None = None) -> DataFrame:
    """One row of price figures for a country, narrowed to a region when one is given."""
    country = countries.filter(F.upper("code") == code.upper()).select(F.col("id").alias("country_id"))
    chosen = active_priced(properties).join(country, "country_id", "left_semi")
    if region is not None:
        names = regions.filter(F.col("name") == region).select(F.col("id").alias("region_id"))
        chosen = chosen.join(names, "region_id", "left_semi")
    return chosen.agg(*adjusted_stats()).select(F.lit(code.upper()).alias("country_code"), "*")


def latest_index(price_index: DataFrame) -> DataFrame:
    """Newest index row of each country."""
    at = F.struct("year", "quarter")
    return price_index.groupBy("country").agg(
        F.max_by(F.struct("quarter", "index_value", "source"), at).alias("r")).select(
        "country", "r.quarter", F.col("r.index_value").alias("value"), "r.source")


def regions_join(regions: DataFrame, properties: DataFrame) -> DataFrame:
    """Active priced properties with the name of their region."""
    names = regions.select(F.col("id").alias("region_id"), F.col("name").alias("region_name"))
    return active_priced(properties).join(names, "region_id")


def region_heatmap(regions: DataFrame, properties: DataFrame) -> DataFrame:
    """Mean price per square metre and count by region; aggregated before the join."""
    per_sqm = F.col("price_adjusted_eur") / F.when(F.col("area_sqm") != 0, F.col("area_sqm"))
    sums = active_priced(properties).groupBy("region_id").agg(
        round_even(F.avg(per_sqm), 2).alias("avg_price_per_sqm"), F.count("*").alias("n"))
    return sums.join(regions.select(F.col("id").alias("region_id"), "name"), "region_id").select(
        "name", "avg_price_per_sqm", "n")


def heatmap_features(heatmap: DataFrame) -> DataFrame:
    """Map features as JSON text, one row each."""
    body = F.struct(F.lit("Feature").alias("type"), F.struct("name", "avg_price_per_sqm", "n").alias("properties"))
    return heatmap.select(F.to_json(body).alias("feature"))


def value_counts(df: DataFrame, column: str, n: int | None = None, default: str | None = None) -> DataFrame:
    value = F.coalesce(F.col(column), F.lit(default)) if default is not None else F.col(column)
    counts = df.select(value.alias("value")).filter("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), "value").limit(n) if n else counts


def filter_options(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("value")).filter(filled("value")).distinct().orderBy("value")


def vat_crosstab(docs: DataFrame, features: DataFrame, property_type: str = "apartment") -> DataFrame:
    """Tax status by construction status: counts and shares."""
    flats = docs.filter((F.col("property_type") == property_type) & F.col("vat_status").isNotNull())
    states = ("completed", "under_construction", "off_plan")
    status = features.filter(F.col("construction_status").isin(*states)).select("doc_id", "construction_status")
    counts = flats.join(status, "doc_id").groupBy("construction_status").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("vat_status") == v).alias(v) for v in ("excluded", "included", "unknown")])
    return counts.select("*", *[round_even(F.col(v) / F.col("n") * 100, 2).alias(f"{v}_pct")
                                for v in ("excluded", "included", "unknown")])


# --- Browse and search ---------------------------------------------------------------------

def browse_filter(df: DataFrame, q: str = "", prop_type: str = "", listing_type: str = "",
                  min_price: float = 0, max_price: float = 0, show_dupes: bool = False) -> DataFrame:
    out = df
    if not show_dupes:
        out = out.filter(col_or_null(df, "duplicate_of", "string").isNull())
    out = out.filter(~F.coalesce(col_or_null(df, "is_wanted", "boolean"), F.lit(False)))
    if q:
        needle, hit = q.lower(), F.lit(False)
        for c in ("title", "locality", "description", "address_raw"):
            hit = hit | F.coalesce(F.lower(col_or_null(df, c, "string")).contains(needle), F.lit(False))
        out = out.filter(hit)
    if prop_type:
        out = out.filter(F.col("property_type") == prop_type)
    if listing_type:
        out = out.filter(F.col("listing_type") == listing_type)
    if min_price > 0:
        out = out.filter(F.coalesce("price_eur", F.lit(0.0)) >= min_price)
    if max_price > 0:
        out = out.filter(~truthy("price_eur") | (F.col("price_eur") <= max_price))
    return out


def browse_order(sort: str, id_col: str = "doc_id") -> list[Column]:
    price, area = F.when(truthy("price_eur"), F.col("price_eur")), F.coalesce("area_sqm", F.lit(0.0))
    first = {"price_asc": price.asc_nulls_last(), "price_desc": F.coalesce(price, F.lit(0.0)).desc(),
             "area_desc": area.desc()}.get(sort, F.col("last_seen").desc_nulls_last())
    return [first, F.col(id_col).asc()]


def browse_sort(df: DataFrame, sort: str = "newest", id_col: str = "doc_id") -> DataFrame:
    return df.orderBy(*browse_order(sort, id_col))


def paginate(df: DataFrame, page: int, per_page: int = 24) -> tuple[DataFrame, int, int]:
    """(rows of the page, total rows, pages); a page past the end becomes the last."""
    total = df.count()
    pages = max(1, -(-total // per_page))
    page = min(max(1, page), pages)
    return df.offset((page - 1) * per_page).limit(per_page), total, pages


def page_index(df: DataFrame, sort: str = "newest", id_col: str = "doc_id") -> DataFrame:
    """`df` with the place of each row (`at`, from 0) in a browse order, as a written table in that order.

    Rows are dealt by range once and numbered by the counts of the ranges before.  A page reads only the row groups whose
    places it covers, so a late page costs what the first one does.
    """
    placed = dense_positions(df, browse_order(sort, id_col), "at")
    path = fresh_path(df.sparkSession, "page_index")
    placed.sortWithinPartitions("at").write.parquet(path)
    return df.sparkSession.read.schema(placed.schema).parquet(path)


def indexed_page(index: DataFrame, page: int, per_page: int = 24) -> tuple[DataFrame, int, int]:
    """As `paginate`, from an index."""
    total = index.agg(F.max("at")).first()[0]
    total = 0 if total is None else total + 1
    pages = max(1, -(-total // per_page))
    first = (min(max(1, page), pages) - 1) * per_page
    return index.filter((F.col("at") >= first) & (F.col("at") < first + per_page)).orderBy("at").drop("at"), total, pages


def search_filter(df: DataFrame, q: str, country: str = "") -> DataFrame:
    texts = [F.when(filled(col_or_null(df, c, "string")), col_or_null(df, c, "string"))
             for c in ("title", "locality", "description", "address_raw", "property_type")]
    out = df.filter(F.lower(F.concat_ws(" ", *texts)).contains(q.lower()))
    return out.filter(F.col("country") == country.upper()) if country else out


def search_top(df: DataFrame, n: int = 100, id_col: str = "doc_id") -> DataFrame:
    return df.orderBy(F.coalesce("price_eur", F.lit(0.0)).desc(), id_col).limit(n)


def bbox_filter(df: DataFrame, min_lat: float, max_lat: float, min_lon: float, max_lon: float,
                property_type: str | None = None, min_price: float | None = None,
                max_price: float | None = None, limit: int | None = 100, id_col: str = "id") -> DataFrame:
    """Active listings strictly inside a box.  `limit` (500 at most, else an error) is the
    page size of the query; None returns all."""
    if limit is not None and not 0 < limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    out = df.filter((F.col("lat") > min_lat) & (F.col("lat") < max_lat) & (F.col("lon") > min_lon)
                    & (F.col("lon") < max_lon) & F.col("is_active"))
    if property_type:
        out = out.filter(F.col("property_type") == property_type)
    if min_price is not None:
        out = out.filter(F.col("price_adjusted_eur") >= min_price)
    if max_price is not None:
        out = out.filter(F.col("price_adjusted_eur") <= max_price)
    return out if limit is None else out.orderBy(id_col).limit(limit)


def property_rows(properties: DataFrame, countries: DataFrame) -> DataFrame:
    """Properties as the API shows them: country code, shown price, price per m²."""
    codes = countries.select(F.col("id").alias("country_id"), F.col("code").alias("country_code"))
    adjusted = F.col("price_adjusted_eur")
    shown = F.when(truthy("price_adjusted_eur"), adjusted).otherwise(F.col("price_eur"))
    return properties.join(codes, "country_id").withColumns({
        "price_per_sqm": F.when(truthy("price_adjusted_eur") & truthy("area_sqm"),
                                price_per_sqm("price_adjusted_eur", "area_sqm")),
        "price_eur": shown})


def property_lookup(properties: DataFrame, countries: DataFrame, property_id) -> DataFrame:
    return property_rows(properties.filter(F.col("id") == property_id), countries)


def valuation_history(valuations: DataFrame, user, n: int = 200) -> DataFrame:
    return (valuations.filter(F.col("user_id") == user)
            .orderBy(F.desc("created_at"), F.desc("id")).limit(n))


# --- Work lists ------------------------------------------------------------------------------

def stale_filter(df: DataFrame, as_of, hours: int = 20) -> DataFrame:
    """Listings last seen more than `hours` ago, or never."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp"))
           - F.unix_timestamp(F.col("last_seen").try_cast("timestamp")))
    return df.filter(F.coalesce(age > hours * 3600, F.lit(True)))


def needs_enrichment(docs: DataFrame, enriched: DataFrame, reprocess: bool = False) -> DataFrame:
    described = docs.filter(filled("description"))
    return described if reprocess else described.join(enriched.select("doc_id"), "doc_id", "left_anti")


def needs_backfill(docs: DataFrame, pages: DataFrame, force: bool = False) -> DataFrame:
    """Listings with a URL that lack a tax status or a cached page."""
    linked = docs.filter(filled("url"))
    if force:
        return linked
    cached = pages.select("doc_id", F.lit(True).alias("__cached")).distinct()
    return (linked.join(cached, "doc_id", "left")
            .filter(F.col("vat_status").isNull() | F.col("__cached").isNull()).drop("__cached"))


def coords_pending(docs: DataFrame) -> DataFrame:
    return docs.filter(filled("url") & ~truthy("map_lat"))


def coords_coverage(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(
        F.count("*").alias("n"), F.count_if(truthy("map_lat")).alias("n_precise"),
        F.count_if(filled("url") & ~truthy("map_lat")).alias("n_pending"))


def clean_export_filter(docs: DataFrame, strict_reference: bool = False) -> DataFrame:
    """Active listings with place, price and area that are neither flagged nor copies.

    `strict_reference` keeps flagged and duplicate listings, as the older export did.
    """
    out = docs.filter(truthy("lat") & truthy("lon") & truthy("price_eur") & truthy("area_sqm")
                      & F.coalesce(F.col("is_active"), F.lit(True)))
    if strict_reference:
        return out
    flags = col_or_null(docs, "suspicious", "array<string>")
    return out.filter(~F.coalesce(F.size(flags) > 0, F.lit(False))
                      & ~filled(col_or_null(docs, "duplicate_of", "string")))
