"""Table operators against brute force and invariants."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from parcelgrid.functions.geo import geodesic_m, haversine_km, planar_km
from parcelgrid.operators import history as H
from parcelgrid.operators import quality as Q
from parcelgrid.operators import ranking as R
from parcelgrid.operators import spatial as S
from parcelgrid.operators import training as T
from parcelgrid.operators.places import resolve_locality


@pytest.fixture(scope="module")
def listings(tables):
    return tables.listings.select("doc_id", "lat", "lon", "locality", "listing_type", "property_type", "area_sqm", "price_eur", "bedrooms").dropDuplicates(["doc_id"]).cache()


def by_id(df, key, value):
    return {r[key]: r[value] for r in df.select(key, value).collect()}


@pytest.mark.parametrize("resolution", [1, 3, 7])
def test_range_count_equals_brute_force(listings, tables, resolution):
    got = by_id(S.radius_count(listings, tables.pois, 1.0, "n", resolution=resolution).filter("lat IS NOT NULL"), "doc_id", "n")
    pairs = listings.alias("a").join(tables.pois.alias("b"), haversine_km("a.lat", "a.lon", "b.lat", "b.lon") <= 1.0)
    want = by_id(pairs.groupBy("a.doc_id").agg(F.count("*").alias("n")), "doc_id", "n")
    assert {k: v for k, v in got.items() if v} == want


def test_range_count_with_a_hot_spot(spark):
    """A third of all rows on one point, counted by both rows and positions."""
    pts = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 35.9).otherwise(35.9 + (F.col("id") % 997) / 20000).alias("lat"),
                                   F.when(F.col("id") % 3 == 0, 14.5).otherwise(14.5 + (F.col("id") % 331) / 9000).alias("lon"))
    got = S.rental_density(pts, pts, 0.5).filter("lat = 35.9 AND lon = 14.5").select("rental_density_2km").distinct().collect()
    want = pts.filter(planar_km("lat", "lon", F.lit(35.9), F.lit(14.5)) <= 0.5).count()
    assert [r[0] for r in got] == [want]


@pytest.mark.parametrize("limit", [200_000, 40])
def test_planar_counts_by_tile_equal_brute_force(spark, monkeypatch, limit):
    """No row of a probe and a cell at its edge is shuffled, also where tiles come in pieces."""
    from parcelgrid.operators import tiles
    monkeypatch.setattr(tiles, "LIMIT", limit)
    pts = spark.range(900).select("id", F.when(F.col("id") % 50 != 0, 35.9 + (F.col("id") * 37 % 211) / 5000).alias("lat"),
                                  F.when(F.col("id") % 70 != 0, 14.5 + (F.col("id") * 53 % 197) / 4000).alias("lon"))
    got = S.rental_density(pts, pts.filter("id % 3 = 0"), 0.7)
    near = pts.alias("a").join(pts.filter("id % 3 = 0").alias("b"), planar_km("a.lat", "a.lon", "b.lat", "b.lon") <= 0.7)
    want = by_id(near.groupBy("a.id").agg(F.count("*").alias("n")), "id", "n")
    assert {r["id"]: r["rental_density_2km"] for r in got.collect()} == {
        r["id"]: want.get(r["id"], 0) if r["lat"] is not None and r["lon"] is not None else None for r in pts.collect()}
    assert "FlatMapCoGroupsInArrow" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("resolution,limit", [(None, 200_000), (4, 200_000), (4, 60)])
def test_similar_rentals_by_tile_equal_brute_force(spark, monkeypatch, resolution, limit):
    """The best rentals whatever circle settles a sale; no pair of a sale and a set of rentals is shuffled."""
    from parcelgrid.functions.common import round_even
    from parcelgrid.operators import tiles
    monkeypatch.setattr(tiles, "LIMIT", limit)
    n = F.col("id")
    rows = spark.range(1400).select(
        F.concat(F.lit("d"), n).alias("doc_id"), (35.8 + (n * 7919 % 1009) / 8000).alias("lat"), (14.4 + (n * 10473 % 1013) / 9000).alias("lon"),
        F.when(n % 19 != 0, 1 + n % 5).alias("rooms"), F.when(n % 11 != 0, (20 + n * 3 % 150).cast("double")).alias("area_sqm"),
        (n % 6).alias("condition"), (300.0 + n).alias("price_eur"), n)
    sales, rentals = rows.filter("id % 4 = 0"), rows.filter("id % 4 <> 0")
    out = S.similar_rentals(sales, rentals, resolution=resolution)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan
    a, b = sales.alias("a"), rentals.alias("b")
    d = planar_km("a.lat", "a.lon", "b.lat", "b.lon")
    gap = F.abs(F.col("a.area_sqm") - F.col("b.area_sqm"))
    cond = F.when((F.col("a.condition") != 0) & (F.col("b.condition") != 0), F.abs(F.col("a.condition") - F.col("b.condition")) / 4.0 * 0.5)
    score = round_even(d / 5.0 * 3.0 + F.coalesce(F.abs(F.col("a.rooms") - F.col("b.rooms")) / 3.0 * 2.0, F.lit(1.0))
                       + F.when(gap.isNull(), 0.0).otherwise(F.least(gap, F.lit(50.0)) / 50.0) + F.coalesce(cond, F.lit(0.0)), 2)
    pairs = a.join(b, d <= 5.0).select(F.col("a.doc_id").alias("sale"), F.col("b.doc_id").alias("rental"), score.alias("s"))
    best = {}
    for r in sorted(pairs.collect(), key=lambda r: (r["sale"], r["s"], r["rental"])):
        best.setdefault(r["sale"], []).append((r["rental"], r["s"]))
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["sale_id"], r["rank"])):
        got.setdefault(r["sale_id"], []).append((r["rental_id"], r["similarity"]))
    assert got == {s: v[:3] for s, v in best.items()}


def test_range_max(listings, tables):
    got = by_id(S.range_aggregate(listings, tables.pois, 2.0, value="poi_id", resolution=4).join(listings, ["lat", "lon"]), "doc_id", "in_range")
    pairs = listings.alias("a").join(tables.pois.alias("b"), haversine_km("a.lat", "a.lon", "b.lat", "b.lon") <= 2.0)
    assert got == by_id(pairs.groupBy("a.doc_id").agg(F.max("b.poi_id").alias("m")), "doc_id", "m")


@pytest.mark.parametrize("resolution", [2, 6])
def test_comparables_equal_brute_force(listings, tables, resolution):
    got = S.comparables(tables.requests, listings, resolution=resolution)
    q, x = tables.requests.alias("q"), listings.alias("l")
    pairs = q.join(x, (F.col("q.property_type") == F.col("l.property_type")) & (F.col("q.listing_type") == F.col("l.listing_type"))
                   & F.col("l.area_sqm").between(F.col("q.area_sqm") * 0.6, F.col("q.area_sqm") * 1.4) & F.col("l.price_eur").isNotNull())
    near = pairs.withColumn("d", geodesic_m("q.lat", "q.lon", "l.lat", "l.lon")).filter("d <= 3000").select("request_id", "doc_id", "d")
    want = R.top_k_per_probe(near, "request_id", ["d", "doc_id"], 8)
    cols = ["request_id", "rank", "doc_id"]
    assert set(map(tuple, got.select(cols).collect())) == set(map(tuple, want.select(cols).collect()))


@pytest.mark.parametrize("method", ["haversine", "degree"])
def test_nearest_poi(listings, tables, method):
    got = S.nearest_poi(listings, tables.pois, {"d": ["hospitals", "cafes"]}, method).filter("lat IS NOT NULL").select("lat", "lon", "d").toPandas()
    p = tables.pois.filter("category IN ('hospitals', 'cafes')").toPandas()
    if method == "degree":
        d = np.sqrt((got.lat.values[:, None] - p.lat.values) ** 2 + (got.lon.values[:, None] - p.lon.values) ** 2).min(1) * 100.4
    else:
        a, b, c, e = (np.radians(v) for v in (got.lat.values[:, None], got.lon.values[:, None], p.lat.values, p.lon.values))
        h = np.sin((c - a) / 2) ** 2 + np.cos(a) * np.cos(c) * np.sin((e - b) / 2) ** 2
        d = (12742 * np.arctan2(np.sqrt(h), np.sqrt(1 - h))).min(1)
    assert np.abs(d - got.d.values).max() <= 0.00051


def test_percentiles_match_the_builtin(listings):
    got = {r["property_type"]: (r["n"], r["a"], r["b"]) for r in R.exact_percentiles(listings, ["property_type"], "price_eur", {"a": 0.5, "b": 0.95}).collect()}
    want = {r["property_type"]: (r["n"], r["a"], r["b"]) for r in listings.groupBy("property_type").agg(
        F.count("price_eur").alias("n"), F.percentile("price_eur", 0.5).alias("a"), F.percentile("price_eur", 0.95).alias("b")).collect()}
    assert got.keys() == want.keys()
    for k in got:
        assert got[k] == pytest.approx(want[k])


@pytest.mark.parametrize("n,sizes", [(7, [2, 2, 1, 1, 1]), (3, [1, 1, 1, 0, 0]), (1, [1, 0, 0, 0, 0])])
def test_fold_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id").cast("string").alias("doc_id"), F.lit("x").alias("locality"), F.lit(35.9).alias("lat"))
    counts = by_id(T.spatial_folds(df).groupBy("fold").agg(F.count("*").alias("n")), "fold", "n")
    assert [counts.get(i, 0) for i in range(5)] == sizes


def test_target_encoding(spark):
    train = spark.createDataFrame([("A", 10.0), ("A", 20.0)] + [("B", 60.0)], "c string, y double")
    apply = spark.createDataFrame([("A",), ("new",)], "c string")
    assert by_id(T.target_encode(train, apply, "c", "y"), "c", "enc") == {"A": pytest.approx((30 + 300) / 12), "new": 30.0}


# --- Change tracking ------------------------------------------------------------------------------

ROW = "doc_id string, source string, country string, scraped_at timestamp, price_eur double, area_sqm double, title string, is_active boolean"


def at(n):
    import datetime as dt
    return dt.datetime(2026, 1, 1) + dt.timedelta(hours=n)


def test_diff_rules(spark):
    schema = "p double, a double, t string, old struct<price_eur:double,area_sqm:double,title:string>, new struct<price_eur:double,area_sqm:double,title:string>"
    def keys(old, new):
        df = spark.createDataFrame([(1.0, 1.0, "", old, new)], schema)
        return sorted(df.select(H.diff_fields(df, "old", "new").alias("d")).first()["d"])
    assert keys((100.0, 1.0, "A "), (100.005, 1.0, "A")) == []
    assert keys((None, None, "A"), (100.0, 90.0, "A")) == ["price_eur"]
    assert keys((100.0, 1.0, "A"), (None, 2.0, None)) == ["area_sqm"]


@pytest.mark.parametrize("chunk, heavy", [(None, 2), (3600, 2), (7200, 2), (3600, 100)])
def test_upsert_of_repeated_keys(spark, chunk, heavy):
    """Rows of one listing apply in order, whichever way long chains are cut."""
    rows = [("a", "s", "MT", at(i), float(100 + i // 2), None if i % 3 else 50.0 + i, f"t{i // 4}", i % 5 != 0) for i in range(12)]
    first = H.upsert_listings(None, spark.createDataFrame(rows[:1], ROW), chunk_seconds=chunk, heavy=heavy)
    done = H.upsert_listings(first.state, spark.createDataFrame(rows[1:][::-1], ROW), chunk_seconds=chunk, heavy=heavy)
    state = done.state.first()
    assert (state["price_eur"], state["area_sqm"], state["title"], state["first_seen"], state["last_seen"]) == (105.0, 59.0, "t2", at(0), at(11))
    events = [(r["date"].hour, r["event"]) for r in done.events.orderBy("date").collect()]
    assert events[0] == (1, "reactivated") and (5, "deactivated") in events and (8, "price_and_content_change") in events
    assert tuple(done.counts.first()) == (0, 11)


def test_indexed_pages_are_the_pages(spark, tables):
    from parcelgrid.operators import market as M
    df = tables.listings
    index = M.page_index(df, "price_desc")
    for page in (1, 17, 10 ** 6):
        want, got = M.paginate(M.browse_sort(df, "price_desc"), page), M.indexed_page(index, page)
        assert want[1:] == got[1:] and [r["doc_id"] for r in want[0].collect()] == [r["doc_id"] for r in got[0].collect()]
    assert M.indexed_page(M.page_index(df.limit(0)), 3)[1:] == (0, 1)


def test_contexts_come_in_bounded_pieces(spark):
    from parcelgrid.operators.places import location_ref_contexts
    refs = spark.createDataFrame([(str(i), " The Bay " if i % 2 else "the bay") for i in range(250)] + [("x", None), ("y", "Hill")], "doc_id string, location_reference string")
    docs = spark.createDataFrame([(str(i), f"place {i % 120:03d}") for i in range(250)] + [("x", "a")], "doc_id string, locality string")
    rows = sorted(location_ref_contexts(refs, docs, 50).collect(), key=lambda r: r["piece"])
    assert [r["n"] for r in rows] == [50, 50, 20] and [c for r in rows for c in r["contexts"]] == [f"place {i:03d}" for i in range(120)]


def test_upsert_deals_rows_once(spark):
    """One exchange and one sort of the steps where no listing is long; long and short listings together give the same."""
    rows = [(d, "s", "MT", at(i % 20), float(100 + i), None, f"t{i // 3}", True) for i in range(60) for d in (("a",) if i % 2 else ("b", "c"))]
    batch = spark.createDataFrame(rows, ROW)
    plan = H.upsert_listings(None, batch, ["price_eur"]).state._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort ") == 1
    whole, cut = (H.upsert_listings(None, batch, ["price_eur"], heavy=n) for n in (1000, 25))
    for part in ("state", "counts"):
        assert getattr(whole, part).exceptAll(getattr(cut, part)).count() == 0
    events = lambda u: u.events.select("doc_id", "date", "event", F.map_keys("changes").alias("k"))
    assert events(whole).exceptAll(events(cut)).count() == 0 and events(whole).count() == events(cut).count()


def test_long_listings_are_found_by_parts(spark, monkeypatch):
    """Only listings of a part with many steps are counted themselves, so that a batch of single steps costs no shuffle of its ids."""
    n = F.col("id")
    batch = spark.range(3000).select(F.when(n % 3 == 0, "long").when(n % 100 == 1, F.lit(None)).otherwise(F.concat(F.lit("d"), n)).alias("doc_id"))
    monkeypatch.setattr(H, "_PARTS", 8)
    assert [r[0] for r in H.long_listings(batch, 900).collect()] == ["long"]
    assert sorted(H.long_listings(batch, 10).collect(), key=lambda r: r[0] or "") == [(None,), ("long",)]
    assert H.long_listings(batch, 1000) is None and H.long_listings(batch, 5000) is None


def test_upsert_twice_changes_nothing(tables):
    batch = tables.batch1.dropDuplicates(["doc_id"]).select("doc_id", "source", "country", F.col("last_seen").cast("timestamp").alias("scraped_at"), "price_eur", "title", "is_active")
    first = H.upsert_listings(None, batch)
    again = H.upsert_listings(first.state, batch)
    assert again.events.count() == 0
    assert again.state.exceptAll(first.state).count() == 0


def test_marks_point_at_the_smallest_copy(spark):
    text = "a long enough description"
    df = spark.createDataFrame([("b", 1.0, None, text), ("a", 1.0, None, text.upper()), ("c", 1.0, 2.0, text), ("d", None, 2.0, text), ("e", 1.0, None, "short")],
                               "doc_id string, price_eur double, area_sqm double, description string")
    assert by_id(Q.mark_duplicates(df), "doc_id", "duplicate_of") == {"a": None, "b": "a", "c": None, "d": None, "e": None}


def test_place_cascade(spark):
    cents = spark.createDataFrame([("Sliema", 35.91, 14.50), ("Msida", 35.89, 14.49), ("Zebbug", 35.87, 14.44), ("Gozo - Zebbug", 36.07, 14.23),
                                   ("Rabat", 35.88, 14.40), ("Gozo - Victoria", 36.04, 14.24), ("St Julian's", 35.92, 14.49)], "locality string, lat double, lon double")
    asked = spark.createDataFrame([(1, "Tas-Sliema", 35.91, 14.5), (2, "L-Imsida", 35.89, 14.49), (3, "Iż-Żebbuġ", 35.87, 14.44), (4, "Iż-Żebbuġ", 36.07, 14.23),
                                   (5, "Ir-Rabat", 35.88, 14.40), (6, "Ir-Rabat", 36.04, 14.24), (7, "San Ġiljan", 35.92, 14.49), (8, "Zzz", 35.911, 14.501), (9, "Zzz", None, None)],
                                  "id int, name string, lat double, lon double")
    got = by_id(resolve_locality(asked, cents), "id", "locality")
    assert got == {1: "Sliema", 2: "Msida", 3: "Zebbug", 4: "Gozo - Zebbug", 5: "Rabat", 6: "Gozo - Victoria", 7: "St Julian's", 8: "Sliema", 9: None}


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("metric", ["haversine", "degree"])
def test_nearest_candidates_send_no_exploded_table_through_the_driver(spark, metric):
    """Points on both sides of block edges; the plan joins exploded tables by sorting, however small they seem."""
    pts = spark.range(40).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("category"),
                                 (35.0 + F.col("id") * 0.0371).alias("lat"), (14.0 - F.col("id") * 0.53).alias("lon"))
    spots = spark.range(25).select((35.2 + F.col("id") * 0.051).alias("lat"), (14.3 - F.col("id") * 0.7).alias("lon"))
    found = S.nearest_candidates(spots, pts, metric=metric)
    assert "Broadcast" not in plan_of(found)
    def away(a, b):
        return haversine_km(a + "lat", a + "lon", b, b.replace("lat", "lon")) if metric == "haversine" else S.degree_distance(a + "lat", a + "lon", b, b.replace("lat", "lon"))
    got = (spots.withColumns(S._fine_cell("lat", "lon")).join(found, ["ci", "cj"]).groupBy("lat", "lon", "category")
           .agg(F.min(away("", "p_lat")).alias("d")))
    want = spots.alias("s").join(pts.alias("p")).groupBy("s.lat", "s.lon", "p.category").agg(F.min(away("s.", "p.lat")).alias("d"))
    rows = lambda df: sorted((round(r[0], 6), round(r[1], 6), r[2], round(r[3], 9)) for r in df.collect())
    assert rows(got) == rows(want)


def test_searches_send_no_exploded_table_through_the_driver(spark):
    rows = spark.range(60).select(F.col("id"), (35.8 + F.col("id") * 0.001).alias("lat"), (14.4 + F.col("id") % 7 * 0.002).alias("lon"),
                                  F.lit("apartment").alias("property_type"), F.lit("sale").alias("listing_type"), (40.0 + F.col("id")).alias("area_sqm"))
    asked = rows.select(F.col("id").alias("request_id"), "lat", "lon", "property_type", "listing_type", "area_sqm")
    near = S.nearest_within(asked, rows, "request_id", "id", 2.0, 3, ["property_type", "listing_type"], 0.4, 4)
    joins = [x for x in plan_of(near).split("\n") if "Join [" in x and "p_ci" in x and "bucket" not in x.split("Inner")[0]]
    assert len(joins) == 2 and all("SortMergeJoin" in x for x in joins)
    assert near.groupBy("request_id").count().agg(F.min("count"), F.max("count")).first()[:] == (3, 3)


def test_dense_positions_are_stored_packed(spark):
    """Rows are written once in columns; the counts of the ranges go to the rows, not the rows to the counts."""
    from parcelgrid.operators.ranking import dense_positions
    df = spark.createDataFrame([(f"k{i:03}", i % 7 or None) for i in range(200)], "id string, v int")
    out = dense_positions(df, [F.col("v").asc_nulls_last(), F.col("id")], "at")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "parquet" in plan and "broadcast" in plan
    want = sorted(((i % 7 or 99, f"k{i:03}") for i in range(200)))
    assert [r["id"] for r in out.orderBy("at").collect()] == [k for _, k in want]
    assert sorted(r["at"] for r in out.collect()) == list(range(200))


def test_written_lines_are_compressed(tables):
    from parcelgrid.checks.storage import written_lines
    from parcelgrid.sources import collections as C
    spark, path = tables.spark, written_lines(tables)
    assert all(f.endswith(".lz4") for f in spark.read.text(path).inputFiles())
    assert C.corrupt_lines(spark, path).count() == tables.listings.filter("ok % 5 = 0").count()


@pytest.mark.parametrize("per_cell, crowded", [(6.0, 1000), (48.0, 1000), (6.0, 4)])
def test_nearest_from_neighbouring_cells_equal_brute_force(spark, monkeypatch, per_cell, crowded):
    """Sparse, crowded and repeated rows; rows without an area or id; requests that come twice."""
    monkeypatch.setattr(S, "_CROWDED", crowded)
    n = F.col("id")
    rows = spark.range(1500).select(
        F.when(n % 37 > 0, n % 701).alias("id"), (35.8 + n * 7919 % 1000 / F.lit(40000.0)).alias("lat"), F.when(n % 41 > 0, 14.4 + n * 104729 % 997 / F.lit(30000.0)).alias("lon"),
        F.when(n % 29 > 0, F.when(n % 3 > 0, "flat").otherwise("house")).alias("kind"), F.when(n % 23 > 0, 40.0 + n % 50).alias("area_sqm"))
    rows = rows.unionAll(rows.limit(40).select("id", F.lit(35.81).alias("lat"), F.lit(14.41).alias("lon"), "kind", "area_sqm"))
    asked = rows.filter("id % 5 = 0 OR id IS NULL").withColumnRenamed("id", "q")
    got = S.nearest_within(asked, rows, "q", "id", 1.0, 4, ["kind"], 0.3, 4, ["area_sqm"], per_cell).select("q", "rank", "distance_m")
    pairs = asked.alias("a").join(rows.alias("b"), F.col("a.kind") == F.col("b.kind")).withColumn("d", geodesic_m("a.lat", "a.lon", "b.lat", "b.lon"))
    pairs = pairs.filter((F.col("d") <= 1000) & F.col("b.area_sqm").isNotNull()
                         & (F.col("a.area_sqm").isNull() | F.col("b.area_sqm").between(F.col("a.area_sqm") * (1 - 0.3), F.col("a.area_sqm") * (1 + 0.3))))
    want = R.top_k_per_probe(pairs.select("a.q", "b.id", F.col("d").alias("distance_m")), "q", ["distance_m", "id"], 4).select("q", "rank", "distance_m")
    look = lambda df: sorted((-1 if r[0] is None else r[0], r[1], round(r[2], 4)) for r in df.collect())
    assert look(got) == look(want)


def test_nearest_makes_one_row_of_a_probe_with_enough_listings_beside_it(spark):
    """Most probes are settled from the listings of the cells around; they are not copied to each cell in reach."""
    rows = spark.range(4000).select("id", (35.8 + F.col("id") * 7919 % 4001 / F.lit(100000.0)).alias("lat"),
                                    (14.4 + F.col("id") * 1047 % 3989 / F.lit(100000.0)).alias("lon"), F.lit("flat").alias("kind"), F.lit(60.0).alias("area_sqm"))
    g = S.Grid(2.0, 4.0, "haversine")
    pool = rows.select("kind", "id", "lat", "lon").withColumns(g.cell("lat", "lon", "o_"))
    near = S.beside(rows.select(F.col("id").alias("q"), "kind", "lat", "lon").withColumns(g.cell("lat", "lon")), pool, g, ["kind"], ["id", "lat", "lon"])
    size = near.select(F.size(F.filter("near", lambda x: geodesic_m("lat", "lon", x["lat"], x["lon"]) <= g.side * 1000)).alias("n"), "q").collect()
    pairs = rows.alias("a").join(rows.alias("b"), geodesic_m("a.lat", "a.lon", "b.lat", "b.lon") <= g.side * 1000).groupBy("a.id").count()
    assert len(size) == 4000 and {r["q"]: r["n"] for r in size} == {r[0]: r[1] for r in pairs.collect()}


@pytest.mark.parametrize("limit", [40, None])
def test_counts_and_largest_values_on_the_sphere_equal_brute_force(spark, monkeypatch, limit):
    """Counts and latest times within a radius, by country, far north, on one point and without a position."""
    import datetime as dt
    rng = np.random.default_rng(8)
    if limit:
        monkeypatch.setattr(S.tiles, "CROWD", limit)

    def place(i, n):
        lat, lon = [(35.9 + rng.uniform(-.06, .06), 14.5 + rng.uniform(-.06, .06)), (78.2 + rng.uniform(-.05, .05), 15.6 + rng.uniform(-.4, .4)),
                    (35.9, 14.5), (-0.001 + rng.uniform(0, .03), rng.uniform(-.03, .03))][i % 4]
        return None if i % 41 == 40 else ("MT", "NO", None)[i % 7 % 3], None if i % 37 == 36 else float(lat), float(lon)

    asked = [(i, *place(i, 200)) for i in range(200)]
    points = [(i, *place(i, 600), None if i % 5 == 0 else dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(rng.integers(0, 500)))) for i in range(600)]
    df = spark.createDataFrame(asked, "q long, country string, lat double, lon double")
    pts = spark.createDataFrame(points, "id long, country string, lat double, lon double, seen timestamp")
    counted = {r["q"]: r["n"] for r in S.radius_count(df, pts, 2.0, "n", match=["country"]).collect()}
    fresh = S.range_aggregate(df, pts, 2.0, value="seen", match=["country"])
    latest = {r["q"]: r["in_range"] for r in S.attach(df, fresh, ["country", "lat", "lon"]).collect()}
    pairs = df.alias("a").join(pts.alias("b"), "country").filter(haversine_km("a.lat", "a.lon", "b.lat", "b.lon") <= 2.0)
    want = {r["q"]: (r["n"], r["latest"]) for r in pairs.groupBy("q").agg(F.count("*").alias("n"), F.max("seen").alias("latest")).collect()}
    assert sum(n for n, _ in want.values()) > 2000
    for q, _, lat, _ in asked:
        assert counted[q] == (None if lat is None else want.get(q, (0, None))[0]) and latest[q] == want.get(q, (0, None))[1]


@pytest.mark.parametrize("around, limit", [(12, None), (800, None), (800, 150)])
def test_nearest_by_tile_equal_brute_force(spark, monkeypatch, around, limit):
    """Sparse, crowded, repeated and far rows; rows without an area, id, kind or position; requests that come twice."""
    monkeypatch.setattr(S, "_AROUND", around)
    if limit:
        monkeypatch.setattr(S.tiles, "CROWD", limit)
    n = F.col("id")
    rows = spark.range(1500).select(
        F.when(n % 37 > 0, n % 701).alias("id"), (35.8 + n * 7919 % 1000 / F.lit(40000.0)).alias("lat"), F.when(n % 41 > 0, 14.4 + n * 104729 % 997 / F.lit(30000.0)).alias("lon"),
        F.when(n % 29 > 0, F.when(n % 3 > 0, "flat").otherwise("house")).alias("kind"), F.when(n % 23 > 0, 40.0 + n % 50).alias("area_sqm"))
    rows = rows.unionAll(rows.limit(40).select("id", F.lit(35.81).alias("lat"), F.lit(14.41).alias("lon"), "kind", "area_sqm"))
    rows = rows.unionAll(rows.limit(60).select("id", F.lit(88.9).alias("lat"), (F.col("lon") * 20 - 290).alias("lon"), "kind", "area_sqm"))
    asked = rows.filter("id % 5 = 0 OR id IS NULL").withColumnRenamed("id", "q")
    got = S.nearest_within(asked, rows, "q", "id", 1.0, 4, ["kind"], 0.3, None, ["area_sqm"]).select("q", "rank", "distance_m")
    pairs = asked.alias("a").join(rows.alias("b"), F.col("a.kind") == F.col("b.kind")).withColumn("d", geodesic_m("a.lat", "a.lon", "b.lat", "b.lon"))
    pairs = pairs.filter((F.col("d") <= 1000) & F.col("b.area_sqm").isNotNull()
                         & (F.col("a.area_sqm").isNull() | F.col("b.area_sqm").between(F.col("a.area_sqm") * (1 - 0.3), F.col("a.area_sqm") * (1 + 0.3))))
    want = R.top_k_per_probe(pairs.select("a.q", "b.id", F.col("d").alias("distance_m")), "q", ["distance_m", "id"], 4).select("q", "rank", "distance_m")
    look = lambda df: sorted((-1 if r[0] is None else r[0], r[1], round(r[2], 4)) for r in df.collect())
    assert look(got) == look(want)
