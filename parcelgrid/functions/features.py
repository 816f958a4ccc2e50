"""Model-feature columns: flags, encodings, imputation, coordinates."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import (
    col, col_or_null, contains_any, filled, lookup, truthy,
)
from parcelgrid.functions.scalar import area_log


def flag(condition) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("double")


# --- Amenities -------------------------------------------------------------------

def extract_amenities(df: DataFrame, classified_sources=("mt_class",)) -> DataFrame:
    """Adds the 14 amenity flags; a source that cannot know a flag leaves it NULL."""
    names = col_or_null(df, "features", "array<string>")
    has_names = F.coalesce(F.size(names) > 0, F.lit(False))
    inputs = set(V.CLASSIFIED_AMENITY_FIELDS.values()) | set(V.PORTAL_AMENITY_FIELDS.values())
    raw = {n: col_or_null(df, n, "int").cast("double") for n in inputs}
    is_classified = F.col("source").isin(list(classified_sources))
    is_portal = F.coalesce(*[col_or_null(df, n, "int").cast("int")
                             for n in V.PORTAL_AMENITY_MARKERS]).isNotNull()

    def from_field(table, name):
        return F.coalesce(raw[table[name]], F.lit(0.0)) if name in table else F.lit(None).cast("double")

    out = {}
    for name, words in V.AMENITY_KEYWORDS.items():
        listed = F.arrays_overlap(names, F.array(*[F.lit(w) for w in words]))
        out[name] = (F.when(has_names, flag(listed))
                     .when(is_classified, from_field(V.CLASSIFIED_AMENITY_FIELDS, name))
                     .when(is_portal, from_field(V.PORTAL_AMENITY_FIELDS, name)))
    return df.withColumns(out)


def location_type_flags(df: DataFrame, names="location_types") -> DataFrame:
    present = col_or_null(df, names, "array<string>")
    return df.withColumns({
        name: flag(F.arrays_overlap(present, F.array(*[F.lit(w) for w in words])))
        for name, words in V.LOCATION_TYPES.items()})


def zone_flags(df: DataFrame) -> DataFrame:
    locality = F.coalesce(F.col("locality"), F.lit(""))
    return df.withColumns({
        "is_premium_zone": flag(filled(col_or_null(df, "zone", "string"))),
        "is_gozo": flag(locality.startswith(V.GOZO)
                        | F.coalesce(col_or_null(df, "province", "string") == V.GOZO, F.lit(False))),
        "is_resort": flag(contains_any(locality, V.RESORT_WORDS)),
    })


# --- Encodings -----------------------------------------------------------------------

def encode_category(value, mapping) -> Column:
    """Code of a category, 0 for an unlisted one, NULL when there is none."""
    value = col(value)
    return F.when(value.isNotNull(), F.coalesce(lookup(mapping, value), F.lit(0)).cast("double"))


def text_feature_columns(df: DataFrame, source: str = "text") -> dict[str, Column]:
    """The 30 encoded columns from a struct of text-derived features."""
    fields = set(df.schema[source].dataType.fieldNames())

    def raw(name, dtype):
        return F.col(f"{source}.{name}") if name in fields else F.lit(None).cast(dtype)

    out = {}
    for name in V.TEXT_NUMERIC:
        out[f"llm_{name}"] = raw(name, "double").cast("double")
    for name in V.TEXT_BOOLEAN:
        out[f"llm_{name}"] = raw(name, "boolean").cast("double")
    for table in (V.TEXT_ORDINAL, V.TEXT_CATEGORICAL):
        for name, mapping in table.items():
            out[f"llm_{name}"] = encode_category(raw(name, "string"), mapping)
    for name in V.IMAGE_NUMERIC:
        out[f"llm_{name}"] = raw(name, "double").cast("double")
    for table in (V.IMAGE_ORDINAL, V.IMAGE_CATEGORICAL):
        for name, mapping in table.items():
            out[f"llm_{name}"] = encode_category(raw(name, "string"), mapping)
    return out


def encode_text_features(df: DataFrame, source: str = "text") -> DataFrame:
    return df.withColumns(text_feature_columns(df, source))


def one_hot(df: DataFrame, layout: str = "request") -> dict[str, Column]:
    """17 columns of a request vector, or 25 of the stored training layout."""
    numerics = V.REQUEST_NUMERICS if layout == "request" else V.STORE_NUMERICS
    out = {n: F.coalesce(col_or_null(df, n, "double").cast("double"), F.lit(-1.0)) for n in numerics}
    for t in V.ONE_HOT_TYPES:
        out[f"type_{t}"] = flag(F.col("property_type") == t)
    for c in V.ONE_HOT_CONDITIONS:
        out[f"cond_{c}"] = flag(col_or_null(df, "condition", "string") == c)
    if layout == "store":
        for b in V.STORE_BOOLEANS:
            out[b] = F.coalesce(col_or_null(df, b, "double").cast("double"), F.lit(0.0))
        out["is_transaction"] = flag(col_or_null(df, "price_type", "string") == "transaction")
    return out


def one_hot_type_condition(df: DataFrame, id_col: str, layout: str = "request") -> DataFrame:
    return df.select(F.col(id_col), *[c.alias(n) for n, c in one_hot(df, layout).items()])


# --- Coordinates ------------------------------------------------------------------------

def pick_coordinates(df: DataFrame, overrides: DataFrame | None = None,
                     id_col: str = "doc_id") -> DataFrame:
    """Best position: precise map point, then geocoded override, then the town's.

    `overrides` is (id, override_lat, override_lon), one row per id.
    """
    out = df
    if overrides is not None:
        out = df.join(overrides.select(id_col, "override_lat", "override_lon"), id_col, "left")
    map_lat, map_lon = col_or_null(out, "map_lat", "double"), col_or_null(out, "map_lon", "double")
    o_lat, o_lon = col_or_null(out, "override_lat", "double"), col_or_null(out, "override_lon", "double")
    precise, geocoded = truthy(map_lat), truthy(o_lat)
    chosen = out.withColumns({
        "lat": F.when(precise, map_lat).when(geocoded, o_lat).otherwise(F.col("lat")),
        "lon": F.when(precise, map_lon).when(geocoded, o_lon).otherwise(F.col("lon")),
        "refined": precise | geocoded,
    })
    return chosen.drop("override_lat", "override_lon")


# --- Serving a request ---------------------------------------------------------------------

def impute_structural(df: DataFrame) -> DataFrame:
    defaults = {n: F.coalesce(F.col(n).cast("double"), F.lit(v))
                for n, v in V.STRUCTURAL_DEFAULTS.items()}
    return df.withColumns({"total_int_area": F.coalesce(F.col("total_int_area").cast("double"),
                                                        F.col("area_sqm").cast("double")),
                           **defaults})


def missing_feature_list(df: DataFrame, uses_province: bool = False, source: str = "text",
                         locality_code: str = "locality_enc") -> Column:
    """Sorted names of the important inputs that the caller did not supply.

    Looks at the raw request, so imputed defaults never hide a gap.
    """
    fields = set(df.schema[source].dataType.fieldNames()) if source in df.columns else set()

    def raw(name):
        return F.col(f"{source}.{name}") if name in fields else F.lit(None)

    gaps = [F.when(F.col(locality_code).isNull(), "locality_enc")]
    if uses_province:
        gaps.append(F.lit("province_enc"))
    for name in ("bathrooms", "rooms", "total_int_area", "total_ext_area"):
        gaps.append(F.when(col_or_null(df, name, "double").isNull(), name))
    form = lookup(V.CONDITION_SCORES, col_or_null(df, "condition", "string"))
    gaps.append(F.when(raw("condition").isNull() & form.isNull(), "llm_condition"))
    for name in ("furnishing", "quality_tier", "construction_status"):
        gaps.append(F.when(raw(name).isNull(), f"llm_{name}"))
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*gaps))))


def area_columns(area) -> dict[str, Column]:
    area = col(area)
    return {"area_sqm": area.cast("double"), "area_sqm_log": area_log(area)}
