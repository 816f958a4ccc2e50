"""Place names, centroids, populations and geocode-cache joins."""
from __future__ import annotations

import difflib
import unicodedata
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import (
    col, col_or_null, filled, lookup, map_lookup, null_if_empty, null_if_zero, round_even, truthy,
)
from parcelgrid.functions.geo import haversine_km
from parcelgrid.functions.scalar import last_part
from parcelgrid.operators.ranking import attach, dense_positions, exact_percentiles
from parcelgrid.operators.spatial import _fine_cell, nearest_candidates


# --- Names ----------------------------------------------------------------------------

def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from the Unicode decomposition."""
    src, dst = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        parts = [c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c)]
        if len(parts) == 1 and parts[0] != chr(code) and parts[0].isascii():
            src.append(chr(code))
            dst.append(parts[0])
    return "".join(src), "".join(dst)


_ACCENTED, _PLAIN = _accent_table()


def _regex_any(words: Iterable[str]) -> str:
    return "|".join(w.replace("'", "\\'") for w in words)


def normalize_place_name(name) -> Column:
    """Lower-case ASCII form of a place name without leading articles."""
    s = F.trim(F.coalesce(col(name), F.lit("")))
    s = F.translate(s, *V.MALTESE_LETTERS)
    s = F.regexp_replace(F.translate(s, _ACCENTED, _PLAIN), r"\p{Mn}", "")
    s = F.translate(F.lower(s), "’", "'")
    s = F.regexp_replace(s, "^(?:" + _regex_any(V.ARTICLE_PREFIXES) + ")+", "")
    return F.trim(F.regexp_replace(F.regexp_replace(s, "[^a-z0-9 ]", " "), r"\s+", " "))


def island_of(lat) -> Column:
    lat = col(lat)
    return F.when(lat.isNull(), "any").when(lat > 36.0, "gozo").otherwise("malta")


def island_keys(centroids: DataFrame) -> DataFrame:
    """(island, key): which keys may be chosen on each island.

    An island without keys of its own may choose among all of them.
    """
    keys = centroids.select(F.col("locality").alias("key")).distinct()
    is_gozo = F.col("key").startswith(V.GOZO)
    sides = keys.agg(F.count_if(is_gozo).alias("g"), F.count_if(~is_gozo).alias("m")).first()
    g = F.lit(bool(sides["g"]))
    m = F.lit(bool(sides["m"]))
    allowed = F.array_compact(F.array(
        F.lit("any"), F.when(is_gozo | ~g, "gozo"), F.when(~is_gozo | ~m, "malta")))
    return keys.select(F.explode(allowed).alias("island"), "key")


def base_name(key) -> Column:
    key = col(key)
    return F.when(key.startswith(V.GOZO_PREFIX), F.substr(key, F.lit(len(V.GOZO_PREFIX) + 1))).otherwise(key)


@F.pandas_udf(T.DoubleType())
def name_ratio(word: pd.Series, option: pd.Series) -> pd.Series:
    """The difflib ratio of two names."""
    scores, matcher, last = [], difflib.SequenceMatcher(), None
    for w, o in zip(word, option):
        if w != last:
            matcher.set_seq2(w)
            last = w
        matcher.set_seq1(o)
        scores.append(matcher.ratio())
    return pd.Series(scores, dtype="float64")


def rare_letters(name, ratio: float) -> Column:
    """The first letters of a name, numbered by repetition and most repeated first: names that share at least `ratio`
    of their letters with each other share one of these."""
    chars, n = F.split(name, ""), F.length(name)
    numbered = F.transform(chars, lambda c, i: F.struct((-F.size(F.filter(F.slice(chars, F.lit(1), i + 1), lambda x: x == c))).alias("nth"), c.alias("letter")))
    return F.slice(F.array_sort(numbered), F.lit(1), (n - F.ceil(n * F.lit(ratio) - 1e-9) + 1).cast("int"))


def fuzzy_names(names: DataFrame, norm_keys: DataFrame, cutoff: float = V.FUZZY_CUTOFF) -> DataFrame:
    """(island, norm) to the closest known norm at or above the cutoff.

    A ratio of `cutoff` needs cutoff / (2 - cutoff) of either name's letters in common, which bounds how far two lengths
    can differ and makes the two share one of their first letters in a common order.  Only such pairs, one row each,
    reach the ratio itself.
    """
    ratio = cutoff / (2 - cutoff)
    asked = names.select("island", "norm", F.explode(rare_letters("norm", ratio)).alias("first"))
    known = norm_keys.select("island", "norm_key", F.explode(rare_letters("norm_key", ratio)).alias("first"))
    shorter, longer = F.least(F.length("norm"), F.length("norm_key")), F.greatest(F.length("norm"), F.length("norm_key"))
    pairs = (asked.join(known, ["island", "first"]).filter(shorter >= longer * F.lit(ratio) - 1e-9)
             .select("island", "norm", "norm_key").distinct())
    scored = pairs.withColumn("score", name_ratio("norm", "norm_key")).filter(F.col("score") >= cutoff)
    return scored.groupBy("island", "norm").agg(F.max(F.struct("score", "norm_key"))["norm_key"].alias("norm_key"))


def nearest_centroid(df: DataFrame, centroids: DataFrame, out: str = "nearest") -> DataFrame:
    """Adds the closest centroid's name among those allowed on the row's island."""
    pts = (island_keys(centroids).join(centroids, F.col("key") == F.col("locality"))
           .select("island", "key", "lat", "lon"))
    spots = (df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
             .select("lat", "lon").distinct().withColumn("island", island_of("lat")))
    cand = nearest_candidates(spots, pts.withColumn("category", F.lit("place")), by=["island"])
    named = cand.join(pts.select("island", F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"), "key"),
                      ["island", "p_lat", "p_lon"])
    dist = haversine_km("lat", "lon", "p_lat", "p_lon")
    best = (spots.withColumns(_fine_cell("lat", "lon")).join(named, ["island", "ci", "cj"])
            .groupBy("lat", "lon").agg(F.min(F.struct(dist.alias("d"), "key"))["key"].alias(out)))
    return attach(df, best, ["lat", "lon"])


def resolve_locality(df: DataFrame, centroids: DataFrame, aliases: Mapping[str, str] | None = None,
                     name: str = "name") -> DataFrame:
    """Adds `locality` and `method`: exact, alias, normalised, fuzzy, nearest or NULL.

    All name work runs on distinct (name, island) pairs; rows only join the answer.
    """
    aliases = V.PLACE_ALIASES if aliases is None else aliases
    keys = island_keys(centroids)
    placed = df.withColumn("island", island_of("lat"))
    names = (placed.select(F.col(name).alias("name"), "island").filter(filled("name")).distinct()
             .withColumn("norm", normalize_place_name("name"))
             .withColumn("alias", lookup(aliases, "norm")))
    known = keys.select("island", F.col("key").alias("name"), F.col("key").alias("exact_key"))
    by_alias = keys.select("island", F.col("key").alias("alias"), F.col("key").alias("alias_key"))
    norm_keys = (keys.withColumn("norm_key", normalize_place_name(base_name("key")))
                 .groupBy("island", "norm_key").agg(F.min("key").alias("key")))
    by_norm = norm_keys.select("island", F.col("norm_key").alias("norm"), F.col("key").alias("norm_hit"))
    step = (names.join(known, ["island", "name"], "left").join(by_alias, ["island", "alias"], "left")
            .join(by_norm, ["island", "norm"], "left"))
    open_names = (step.filter(F.coalesce("exact_key", "alias_key", "norm_hit").isNull() & (F.col("norm") != ""))
                  .select("island", "norm").distinct())
    fuzzy = (fuzzy_names(open_names, norm_keys)
             .join(norm_keys.select("island", "norm_key", F.col("key").alias("fuzzy_key")),
                   ["island", "norm_key"]).select("island", "norm", "fuzzy_key"))
    has_norm = F.col("norm") != ""
    answer = step.join(fuzzy, ["island", "norm"], "left").select(
        "island", "name",
        F.coalesce(F.col("exact_key"), F.when(has_norm, F.coalesce("alias_key", "norm_hit", "fuzzy_key"))).alias("by_name"),
        F.when(F.col("exact_key").isNotNull(), "exact").when(F.col("alias_key").isNotNull(), "alias")
        .when(F.col("norm_hit").isNotNull(), "normalised").when(F.col("fuzzy_key").isNotNull(), "fuzzy").alias("how"))
    out = attach(placed.withColumnRenamed(name, "name") if name != "name" else placed, answer, ["name", "island"])
    located = nearest_centroid(out, centroids, "by_place")
    done = located.withColumns({
        "locality": F.coalesce("by_name", "by_place"),
        "method": F.coalesce(F.col("how"), F.when(F.col("by_place").isNotNull(), "nearest"))})
    done = done.drop("by_name", "by_place", "how", "island")
    return done.withColumnRenamed("name", name) if name != "name" else done


# --- Centroids ---------------------------------------------------------------------------

def best_position(df: DataFrame) -> tuple[Column, Column]:
    lat = F.coalesce(null_if_zero(col_or_null(df, "map_lat", "double")), F.col("lat"))
    lon = F.coalesce(null_if_zero(col_or_null(df, "map_lon", "double")), F.col("lon"))
    return lat, lon


def locality_centroids(docs: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Exact median position per locality, rounded to six digits."""
    lat, lon = best_position(docs)
    placed = (docs.filter(filled("locality")).select("locality", lat.alias("lat"), lon.alias("lon"))
              .filter(truthy("lat") & truthy("lon")))
    if keys is not None:
        placed = placed.join(keys.select(F.col("key").alias("locality")).distinct(), "locality", "left_semi")
    lats = exact_percentiles(placed, ["locality"], "lat", {"lat": 0.5}).drop("n")
    lons = exact_percentiles(placed, ["locality"], "lon", {"lon": 0.5}).drop("n")
    return lats.join(lons, "locality").select(
        "locality", round_even("lat", 6).alias("lat"), round_even("lon", 6).alias("lon"))


def encoder_localities(a: DataFrame, b: DataFrame, column: str = "locality") -> DataFrame:
    """Keys known to either of two encoders."""
    return a.select(F.col(column).alias("key")).union(b.select(F.col(column).alias("key"))).distinct()


def missing_keys(keys: DataFrame, centroids: DataFrame) -> DataFrame:
    return keys.select("key").join(centroids.select(F.col("locality").alias("key")), "key", "left_anti")


def city_population(df: DataFrame, populations: DataFrame) -> DataFrame:
    """Adds the population of the locality, else of its last part, else of the address's."""
    people = populations.filter(truthy("population")).select("city", F.col("population").cast("double"))
    address = col_or_null(df, "address_raw", "string")
    keyed = df.withColumns({
        "__c1": F.col("locality"),
        "__c2": F.when(F.col("locality").contains(","), last_part("locality")),
        "__c3": F.when(address.contains(","), last_part(address))})
    for i in (1, 2, 3):
        keyed = attach(keyed, people.select(F.col("city").alias(f"__c{i}"), F.col("population").alias(f"__p{i}")),
                       [f"__c{i}"])
    found = F.coalesce("__p1", "__p2", "__p3")
    return keyed.withColumns({"city_population": found, "city_population_log": F.log(found)}).drop(
        *[f"__{x}{i}" for x in "cp" for i in (1, 2, 3)])


# --- Geocode cache -----------------------------------------------------------------------

def cache_key(reference, context) -> Column:
    """The one key form used both to write and to read the cache."""
    return F.concat(F.lower(F.trim(col(reference))), F.lit("|"), F.coalesce(col(context), F.lit("")))


def join_geocode_cache(refs: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    """Adds status (found, not_found, uncached), lat and lon from the cache.

    `cache` is (cache_key, found, lat, lon); an entry with found = false is a
    remembered miss.
    """
    c = cache.select(F.col("cache_key").alias(key), "found", F.col("lat").alias("g_lat"), F.col("lon").alias("g_lon"))
    joined = attach(refs, c, [key])
    status = F.when(F.col("found").isNull(), "uncached").when(F.col("found"), "found").otherwise("not_found")
    return joined.withColumns({"status": status, "lat": F.when(F.col("found"), F.col("g_lat")),
                               "lon": F.when(F.col("found"), F.col("g_lon"))}).drop("found", "g_lat", "g_lon")


def uncached_refs(refs: DataFrame, cache: DataFrame, key: str = "cache_key") -> DataFrame:
    return refs.select(key).distinct().join(cache.select(F.col("cache_key").alias(key)), key, "left_anti")


def apply_geocode(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """Coordinates by neighbourhood and city; documents without a hit keep their own."""
    city = F.when(F.col("address_raw").contains(","), last_part("address_raw"))
    keyed = docs.withColumn("__key", F.when(filled("locality") & filled(city),
                                            F.concat(F.col("locality"), F.lit("|"), city)))
    hits = cache.filter("found").select(F.col("cache_key").alias("__key"), F.col("lat").alias("g_lat"),
                                        F.col("lon").alias("g_lon"))
    return attach(keyed, hits, ["__key"]).withColumns({
        "lat": F.coalesce("g_lat", "lat"), "lon": F.coalesce("g_lon", "lon")}).drop("__key", "g_lat", "g_lon")


def location_refs(features: DataFrame, docs: DataFrame) -> DataFrame:
    """One row per document that names a place: lower-cased reference and its context."""
    named = features.filter(filled("location_reference"))
    address = col_or_null(docs, "address_raw", "string")
    context = docs.select("doc_id", F.coalesce(null_if_empty(address), F.col("locality"), F.lit("")).alias("context"))
    return named.join(context, "doc_id", "left").select(
        "doc_id", F.lower(F.trim("location_reference")).alias("ref"),
        F.trim("location_reference").alias("original"), "context")


def location_ref_index(features: DataFrame, docs: DataFrame) -> DataFrame:
    """Distinct references: first spelling, first context, number of contexts and uses.

    Contexts stay a count here; `location_ref_contexts` has all of them in pieces of bounded size, so a much used
    reference never turns into one huge array.
    """
    refs = location_refs(features, docs)
    per_context = refs.groupBy("ref", "context").agg(
        F.count("*").alias("n"), F.min(F.struct("doc_id", "original")).alias("first"))
    return per_context.groupBy("ref").agg(
        F.min("first")["original"].alias("original"), F.min("context").alias("locality"),
        F.count("context").alias("n_localities"), F.sum("n").alias("n"))


def location_ref_contexts(features: DataFrame, docs: DataFrame, size: int = 1000) -> DataFrame:
    """All distinct contexts of each reference in numbered pieces of at most `size`, in order.

    Places come from range counts over all (reference, context) pairs, so a reference with very many contexts is spread over
    many tasks and rows and no array grows with it.
    """
    pairs = location_refs(features, docs).filter(F.col("context").isNotNull()).select("ref", "context").distinct()
    placed = dense_positions(pairs, [F.col("ref"), F.col("context")], "at")
    first = placed.groupBy("ref").agg(F.min("at").alias("first"))
    piece = F.floor((F.col("at") - F.col("first")) / F.lit(size)).cast("int")
    return (attach(placed, first, ["ref"], "inner").groupBy("ref", piece.alias("piece"))
            .agg(F.array_sort(F.collect_list("context")).alias("contexts"), F.count("*").alias("n")))


def geocode_stats(refs: DataFrame, cache: DataFrame) -> DataFrame:
    """References per cache status."""
    keyed = refs.withColumn("cache_key", cache_key("ref", "locality"))
    return join_geocode_cache(keyed, cache).groupBy("status").agg(F.count("*").alias("n"))


def top_refs(refs: DataFrame, cache: DataFrame, n: int = 20) -> DataFrame:
    top = refs.orderBy(F.desc("n"), "ref").limit(n).withColumn("cache_key", cache_key("ref", "locality"))
    return join_geocode_cache(top, cache).select("original", "n", "status", "lat", "lon")


def coordinate_overrides(features: DataFrame, docs: DataFrame, cache: DataFrame) -> DataFrame:
    """(doc_id, override_lat, override_lon) for references the cache has found."""
    refs = location_refs(features, docs).withColumn("cache_key", cache_key("ref", "context"))
    hit = join_geocode_cache(refs, cache).filter((F.col("status") == "found") & truthy("lat"))
    return hit.select("doc_id", F.col("lat").alias("override_lat"), F.col("lon").alias("override_lon"))


def centroid_locality_join(docs: DataFrame, centroids: DataFrame,
                           alias: Mapping[str, str | None] | None = None,
                           cache: DataFrame | None = None) -> DataFrame:
    """Coordinates for documents that only name a place: the place itself, its other
    name, then the cache.  A name mapped to nothing is left without coordinates."""
    alias = V.CLASSIFIED_LOCALITIES if alias is None else alias
    other = map_lookup({k: v for k, v in alias.items() if v is not None}, "locality")
    skip = F.col("locality").isin([k for k, v in alias.items() if v is None])
    usable = filled("locality") & (F.col("locality") != "?")
    has_own = truthy("lat")
    pts = centroids.select("locality", F.col("lat").alias("c_lat"), F.col("lon").alias("c_lon"))
    out = attach(docs, pts, ["locality"])
    out = attach(out.withColumn("__alias", other),
                 pts.select(F.col("locality").alias("__alias"), F.col("c_lat").alias("a_lat"),
                            F.col("c_lon").alias("a_lon")), ["__alias"])
    found = {"lat": [F.col("c_lat"), F.when(~skip, F.col("a_lat"))],
             "lon": [F.col("c_lon"), F.when(~skip, F.col("a_lon"))]}
    extra = ["__alias", "c_lat", "c_lon", "a_lat", "a_lon"]
    if cache is not None:
        hits = cache.filter("found").select(F.col("cache_key").alias("__key"), F.col("lat").alias("k_lat"),
                                            F.col("lon").alias("k_lon"))
        out = attach(out.withColumn("__key", F.concat(F.lower("locality"), F.lit("|"))), hits, ["__key"])
        found["lat"].append(F.when(~skip, F.col("k_lat")))
        found["lon"].append(F.when(~skip, F.col("k_lon")))
        extra += ["__key", "k_lat", "k_lon"]
    return out.withColumns({
        c: F.when(has_own | ~usable, F.col(c)).otherwise(F.coalesce(*found[c], F.col(c))) for c in ("lat", "lon")
    }).drop(*extra)
