"""Distance joins on a latitude/longitude grid.

Nothing here pairs every row with every row.  Positions that repeat are counted
once; whole cells that lie inside a radius are added as cell totals; only cells
that straddle the edge are compared point by point; and nearest-k searches use
cell totals to bound the k-th distance before any listing is touched.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import once, round_even
from parcelgrid.functions.geo import KM_PER_DEGREE, geodesic_m, haversine_km, planar_km
from parcelgrid.operators import tiles
from parcelgrid.operators.ranking import attach, top_k_per_probe

Metric = Callable[[Column, Column, Column, Column], Column]
# Kilometres per degree of latitude, never more than either metric's own figure.
_LAT_KM = 111.0
METRICS: dict[str, Metric] = {"haversine": haversine_km, "planar": planar_km}


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all tasks before a step that does much work per row.

    Tables of cells are small in bytes, so adaptive execution would otherwise fold
    them into a few tasks and run the distance work there.
    """
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n, *keys)


def unfolded(df: DataFrame) -> DataFrame:
    """Rows that an explode has made many of: joined by sorting.

    Spark takes an exploded table to be as small as what it came from, and would send it whole through the driver.
    """
    return df.hint("merge")


class Grid:
    """Square-ish cells of about `radius / cells_per_radius` kilometres.

    Longitude cells are sized in degrees so that a cell is never narrower than
    wanted up to `max_lat` degrees of latitude.
    """

    def __init__(self, radius_km: float, cells_per_radius: int, metric: str, max_lat: float = 60.0):
        side = radius_km / cells_per_radius
        lon_km = V.PLANAR_LON_KM if metric == "planar" else _LAT_KM * math.cos(math.radians(max_lat))
        self.radius, self.per_radius, self.metric = radius_km, cells_per_radius, METRICS[metric]
        self.side, self.step_lat, self.step_lon = side, side / _LAT_KM, side / lon_km

    def cell(self, lat: str, lon: str, prefix: str = "") -> dict[str, Column]:
        return {f"{prefix}ci": F.floor(F.col(lat) / F.lit(self.step_lat)).cast("long"),
                f"{prefix}cj": F.floor(F.col(lon) / F.lit(self.step_lon)).cast("long")}

    def center(self, prefix: str = "") -> tuple[Column, Column]:
        return ((F.col(f"{prefix}ci") + 0.5) * F.lit(self.step_lat),
                (F.col(f"{prefix}cj") + 0.5) * F.lit(self.step_lon))

    def half_diagonal(self, prefix: str = "") -> Column:
        """No point of the cell is farther than this from the cell's centre."""
        lat, lon = self.center(prefix)
        low, half_lat, half_lon = F.abs(lat), self.step_lat / 2, self.step_lon / 2
        # The long side of a cell is the one nearer the equator.
        edge = F.greatest(low - half_lat, F.lit(0.0))
        return self.metric(low, lon * 0, edge, lon * 0 + F.lit(half_lon)) * F.lit(1.000001) + F.lit(1e-9)

    def geometry(self, cells: DataFrame, prefix: str = "") -> DataFrame:
        """Adds each cell's centre and half diagonal."""
        lat, lon = self.center(prefix)
        return cells.withColumns({f"{prefix}clat": lat, f"{prefix}clon": lon, f"{prefix}half": self.half_diagonal(prefix)})

    def gap(self) -> Column:
        return self.metric(F.col("clat"), F.col("clon"), F.col("p_clat"), F.col("p_clon"))

    def lon_km(self, lat: Column, away: float) -> Column:
        """Width in kilometres of one cell at the most distant latitude in question."""
        if self.metric is planar_km:
            return F.lit(self.side)
        farthest = F.least(F.abs(lat) + away, F.lit(89.9))
        return F.lit(self.step_lon * _LAT_KM) * F.cos(F.radians(farthest))

    def block(self, prefix: str = "") -> dict[str, Column]:
        """The radius-sized block of a cell."""
        return {"bi": F.floor(F.col(f"{prefix}ci") / self.per_radius).cast("long"),
                "bj": F.floor(F.col(f"{prefix}cj") / self.per_radius).cast("long")}

    def into_blocks(self, cells: DataFrame, prefix: str) -> DataFrame:
        """Each cell once per block that has positions within the radius of it."""
        lat, _ = self.center(prefix)
        width = self.lon_km(lat, self.step_lat * (self.per_radius + 1)) * self.per_radius
        span = F.least(F.ceil(F.lit(self.radius) / width), F.lit(math.ceil(360 / (self.step_lon * self.per_radius))))
        at = self.block(prefix)
        out = cells.withColumn("bi", F.explode(F.array(at["bi"] - 1, at["bi"], at["bi"] + 1)))
        return out.withColumn("bj", F.explode(F.transform(F.sequence(-span, span), lambda d: at["bj"] + d)))

    def around(self, rows: DataFrame, reach_km) -> DataFrame:
        """Each row once per cell (p_ci, p_cj) that a circle of `reach_km` can touch."""
        reach = F.least(reach_km, F.lit(float(self.radius)))
        up = F.ceil(reach / self.side) + 1
        lat, _ = self.center()
        across = F.least(F.ceil(reach / self.lon_km(lat, self.step_lat * (self.per_radius + 1))) + 1,
                         F.lit(math.ceil(360 / self.step_lon)))
        out = rows.withColumn("p_ci", F.explode(F.transform(F.sequence(-up, up), lambda d: F.col("ci") + d)))
        return out.withColumn("p_cj", F.explode(F.transform(F.sequence(-across, across), lambda d: F.col("cj") + d)))


def crowding(points: DataFrame, radius_km: float, metric: str, lat="lat", lon="lon") -> float:
    """Points that a typical point shares a radius-sized cell with (one small job)."""
    return crowding_by(points, radius_km, metric, (), lat, lon)[0]


def crowding_by(points: DataFrame, radius_km: float, metric: str, by: Sequence[str], lat="lat", lon="lon") -> tuple[float, float]:
    """Points of the same `by` columns that a typical point shares a radius-sized cell with, and the
    latitude that no point is beyond (60 degrees at most)."""
    coarse = Grid(radius_km, 1, metric)
    per_cell = (points.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
                .select(*by, lat, lon).distinct().withColumns(coarse.cell(lat, lon))
                .groupBy(*by, "ci", "cj").agg(F.count("*").cast("double").alias("n"), F.max(F.abs(F.col(lat))).alias("top")))
    row = per_cell.agg(F.sum(F.col("n") * F.col("n")).alias("s2"), F.sum("n").alias("s1"), F.max("top").alias("top")).first()
    return (row["s2"] / row["s1"], min(60.0, row["top"] + 1.0)) if row and row["s1"] else (1.0, 60.0)


def choose_resolution(points: DataFrame, radius_km: float, metric: str, lat="lat", lon="lon",
                      low: int = 2, high: int = 48) -> int:
    """Cells per radius for counting.  Finer cells move work from point pairs to cell
    totals; the two balance at the cube root of the crowding."""
    return int(min(high, max(low, round((2.5 * crowding(points, radius_km, metric, lat, lon)) ** (1 / 3)))))


def choose_search_resolution(crowd: float, per_cell: float = 10.0, low: int = 3, high: int = 48) -> int:
    """Cells per radius for nearest-k searches: about `per_cell` of the `crowd` points in a cell."""
    return int(min(high, max(low, round((crowd / per_cell) ** 0.5))))


def range_aggregate(probes: DataFrame, points: DataFrame, radius_km: float, metric: str = "haversine",
                    value: str | None = None, resolution: int | None = None,
                    match: Sequence[str] = (), lat="lat", lon="lon") -> DataFrame:
    """Per distinct probe position: `in_range` points within the radius (count), or
    the largest `value` among them.  Exact.  Returns (match.., lat, lon, in_range).

    Positions without any point in range are absent.  Tiles are worked through (`tiles`); with a `resolution`, and
    for what tiles do not know, cells are joined.
    """
    if resolution is None and (metric == "haversine" or (value is None and not match)):
        has_position = F.col(lat).isNotNull() & F.col(lon).isNotNull()
        spots = probes.filter(has_position).select(*match, F.col(lat).alias("lat"), F.col(lon).alias("lon")).distinct()
        places = (points.filter(has_position).groupBy(*match, F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon"))
                  .agg((F.count("*") if value is None else F.max(value)).alias("p_w")))
        if metric == "planar":
            return tiles.planar_counts(spots, places, radius_km, spread)
        return tiles.sphere_aggregate(spots, places, radius_km, match, value is not None, spread)
    if resolution is None:
        resolution = choose_resolution(points, radius_km, metric, lat, lon)
    g, match = Grid(radius_km, resolution, metric), list(match)
    has_position = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    spots = (probes.filter(has_position).select(*match, F.col(lat).alias("lat"), F.col(lon).alias("lon"))
             .distinct().withColumns(g.cell("lat", "lon")))
    measure = F.count("*") if value is None else F.max(value)
    places = (points.filter(has_position).groupBy(*match, F.col(lat).alias("p_lat"), F.col(lon).alias("p_lon"))
              .agg(measure.alias("p_w")).withColumns(g.cell("p_lat", "p_lon", "p_")))
    combine = F.sum if value is None else F.max
    cells = g.geometry(places.groupBy(*match, "p_ci", "p_cj").agg(combine("p_w").alias("c_w")), "p_")
    asked = g.geometry(spots.select(*match, "ci", "cj").distinct()).withColumns(g.block())
    slack = F.col("half") + F.col("p_half")
    pairs = (spread(asked, *match, "bi", "bj").join(unfolded(spread(g.into_blocks(cells, "p_"), *match, "bi", "bj")), [*match, "bi", "bj"])
             .withColumns({"near": g.gap() + slack, "far": g.gap() - slack})
             .filter(F.col("far") <= radius_km))
    whole = (pairs.filter(F.col("near") <= radius_km).groupBy(*match, "ci", "cj")
             .agg(combine("c_w").alias("whole")))
    edge = pairs.filter(F.col("near") > radius_km).select(*match, "ci", "cj", "p_ci", "p_cj", "c_w")
    if value is not None:
        # A cell at the edge matters only if it could beat what is surely inside.
        edge = (attach(edge, whole, [*match, "ci", "cj"])
                .filter(F.col("whole").isNull() | (F.col("c_w") > F.col("whole"))).drop("whole"))
    checked = (spots.join(edge.drop("c_w"), [*match, "ci", "cj"])
               .join(places, [*match, "p_ci", "p_cj"])
               .filter(g.metric(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon")) <= radius_km)
               .groupBy(*match, "lat", "lon").agg(combine("p_w").alias("part")))
    both = attach(attach(spots, whole, [*match, "ci", "cj"]), checked, [*match, "lat", "lon"])
    if value is None:
        total = F.coalesce(F.col("whole"), F.lit(0)) + F.coalesce(F.col("part"), F.lit(0))
        return both.select(*match, "lat", "lon", total.alias("in_range")).filter(F.col("in_range") > 0)
    return (both.select(*match, "lat", "lon", F.greatest("whole", "part").alias("in_range"))
            .filter(F.col("in_range").isNotNull()))


def planar_counts(df: DataFrame, points: DataFrame, radius_km: float) -> DataFrame:
    """The count per distinct probe position in planar kilometres, tile by tile: (lat, lon, in_range)."""
    has_position = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    places = (points.filter(has_position).groupBy(F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
              .agg(F.count("*").alias("p_w")))
    return tiles.planar_counts(df.filter(has_position).select("lat", "lon").distinct(), places, radius_km, spread)


def radius_count(df: DataFrame, points: DataFrame, radius_km: float, name: str,
                 metric: str = "haversine", resolution: int | None = None,
                 match: Sequence[str] = ()) -> DataFrame:
    """Adds the number of points within the radius; NULL where there is no position."""
    if metric == "planar" and resolution is None and not match:
        out = df.join(planar_counts(df, points, radius_km), ["lat", "lon"], "left").select(*df.columns, "in_range")
    else:
        out = attach(df, range_aggregate(df, points, radius_km, metric, None, resolution, match), [*match, "lat", "lon"])
    present = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return out.withColumn(name, F.when(present, F.coalesce("in_range", F.lit(0)))).drop("in_range")


def rental_density(df: DataFrame, rentals: DataFrame, radius_km: float = 2.0,
                   name: str = "rental_density_2km", resolution: int | None = None) -> DataFrame:
    return radius_count(df, rentals, radius_km, name, "planar", resolution)


def density_count(requests: DataFrame, listings: DataFrame, as_of, radius_km: float = 2.0,
                  days: int = 365, match: Sequence[str] = ("country",), created: str = "created_at") -> DataFrame:
    """Adjusted-price listings near each request that were created within the last year."""
    cutoff = F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {int(days)} DAYS")
    recent = listings.filter(F.col("price_adjusted_eur").isNotNull()
                             & (F.col(created).cast("timestamp") >= cutoff))
    return radius_count(requests, recent, radius_km, "density_n", match=match)


def freshness_max(requests: DataFrame, listings: DataFrame, radius_km: float = 5.0,
                  match: Sequence[str] = ("country",), seen: str = "scraped_at") -> DataFrame:
    """Latest scrape time among priced listings near each request."""
    priced = listings.filter(F.col("price_adjusted_eur").isNotNull())
    latest = range_aggregate(requests, priced, radius_km, value=seen, match=match)
    return attach(requests, latest.withColumnRenamed("in_range", "latest"), [*match, "lat", "lon"])


# --- Nearest k within a radius ------------------------------------------------------------

_AREA_STEP = 0.05
_CROWDED = 1000       # rows of one cell beyond which a search goes by cell totals
_AROUND = 800         # listings in the first circle around a probe


def _area_bucket(area: Column) -> Column:
    return F.floor(F.log(area) / F.lit(_AREA_STEP)).cast("long")


def beside(asked: DataFrame, pool: DataFrame, g: Grid, match: Sequence[str], columns: Sequence[str],
           crowded: int | None = None) -> DataFrame:
    """Each asked row once, with `near`: the pool's rows of its cell and of the cells within one cell's side of it.

    The pool is copied to the neighbouring cells and an asked row stays one row. `near` is NULL where one of the
    cells holds more than `crowded` rows. The pool is placed by o_ci and o_cj, the asked rows get ci and cj.
    """
    crowded = _CROWDED if crowded is None else crowded
    key, lat = [*match, "o_ci", "o_cj"], g.center("o_")[0]
    across = F.least(F.ceil(F.lit(g.side) / g.lon_km(lat, g.step_lat * 2)), F.lit(math.ceil(360 / g.step_lon)))
    totals = pool.groupBy(*key).agg(F.count("*").alias("__n"))
    item = F.struct(*columns)
    few = pool.join(unfolded(totals.filter(F.col("__n") <= crowded)), key).select(*key, item.alias("__row"))
    many = totals.filter(F.col("__n") > crowded).select(*key, F.lit(None).cast(few.schema["__row"].dataType).alias("__row"))
    placed = (few.unionByName(many)
              .withColumn("ci", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.col("o_ci") + d)))
              .withColumn("cj", F.explode(F.transform(F.sequence(-across, across), lambda d: F.col("o_cj") + d))))
    packed = placed.groupBy(*match, "ci", "cj").agg(
        F.collect_list("__row").alias("near"), F.count_if(F.col("__row").isNull()).alias("__many"))
    none = F.array().cast(packed.schema["near"].dataType)
    return (unfolded(asked).join(packed, [*match, "ci", "cj"], "left")
            .withColumn("near", F.when(F.coalesce("__many", F.lit(0)) == 0, F.coalesce("near", none))).drop("__many"))


def _nearest_by_tile(asked: DataFrame, pool: DataFrame, radius_km: float, k: int, match: Sequence[str], tolerance: float,
                     first_km: float, facts: Mapping[str, Column]) -> DataFrame:
    """`nearest_within` over probes (q_id, match.., lat, lon, q_area) and its pool of listings."""
    bounded = F.coalesce(F.col("q_area") > 0, F.lit(False))
    low, high = F.col("q_area") * F.lit(1 - tolerance), F.col("q_area") * F.lit(1 + tolerance)
    probes = asked.withColumns({
        "alone": F.count("*").over(Window.partitionBy("q_id")) == 1, "lat": F.col("lat").cast("double"), "lon": F.col("lon").cast("double"),
        "q_low": F.when(bounded, low.cast("double")).otherwise(F.lit(float("-inf"))),
        "q_high": F.when(bounded, high.cast("double")).otherwise(F.lit(float("inf")))}).drop("q_area")
    points = pool.withColumns({"p_lat": F.col("l_lat").cast("double"), "p_lon": F.col("l_lon").cast("double")}).drop("l_lat", "l_lon")
    near = tiles.nearest(probes, points, radius_km, k, match, first_km, spread).withColumn(
        "distance_m", geodesic_m("lat", "lon", "p_lat", "p_lon")).filter(F.col("distance_m") <= radius_km * 1000.0)
    near = near.drop("lat", "lon").withColumnsRenamed({"p_lat": "l_lat", "p_lon": "l_lon"})
    found = near.select("q_id", "l_id", "distance_m", *[c.alias(n) for n, c in facts.items()], "rank", "final")
    open_ = top_k_per_probe(found.filter("NOT final").drop("rank", "final"), "q_id", ["distance_m", "l_id"], k)
    return found.filter("final").drop("final").unionByName(open_)


def nearest_within(probes: DataFrame, listings: DataFrame, probe_id: str, listing_id: str, radius_km: float,
                   k: int, match: Sequence[str], tolerance: float, resolution: int | None = None,
                   carry: Sequence[str] = (), per_cell: float = 48.0) -> DataFrame:
    """The k nearest listings within the radius and area tolerance of each probe, with their columns `carry`.

    1. Listings at one position with the same type and area are interchangeable, so
       only the k lowest ids of each such set can ever be chosen.
    2. A probe looks at its own cell and those around, of about `per_cell` listings each.
       k listings found within one cell's side are the nearest.
    3. For the other probes cell totals per type and area bucket give a distance within
       which at least k listings surely exist.
    4. Only cells that reach inside that distance are opened.
    A probe without an area accepts every area.  Without a `resolution`, steps 2 to 4 are a search tile by tile (`tiles`):
    the listings within a circle of about `_AROUND` of them settle most probes, the others look within the radius.
    """
    match = list(match)
    facts = {**{c: F.col(f"__{c}") for c in carry}, **{c: F.col(c) for c in match},
             "lat": F.col("l_lat"), "lon": F.col("l_lon"), "area_sqm": F.col("l_area")}
    facts = {c: facts[c] for c in carry}
    own = [F.col(c).alias(f"__{c}") for c in carry if c not in (*match, "lat", "lon", "area_sqm")]
    usable = listings.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull() & F.col("area_sqm").isNotNull())
    asked = (probes.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
             .select(F.col(probe_id).alias("q_id"), *match, "lat", "lon", F.col("area_sqm").alias("q_area")))
    if match:  # the few kinds that are asked for
        usable = usable.join(F.broadcast(asked.select(*match).distinct()), match, "left_semi")
    crowd, max_lat = crowding_by(usable, radius_km, "haversine", match)
    same = [*match, "lat", "lon", "area_sqm"]
    pool = (usable.select(*match, F.col("lat"), F.col("lon"), "area_sqm", F.col(listing_id).alias("l_id"), *own)
            .withColumn("r", F.row_number().over(Window.partitionBy(*same).orderBy("l_id")))
            .filter(F.col("r") <= k).drop("r")
            .withColumnsRenamed({"lat": "l_lat", "lon": "l_lon", "area_sqm": "l_area"}))
    if resolution is None:
        return (_nearest_by_tile(asked, pool, radius_km, k, match, tolerance, min(radius_km, radius_km * (_AROUND / (math.pi * crowd)) ** 0.5), facts)
                .withColumnsRenamed({"q_id": probe_id, "l_id": listing_id}))
    g = Grid(radius_km, resolution, "haversine")
    pool = pool.withColumns({**g.cell("l_lat", "l_lon", "p_"), "bucket": _area_bucket(F.col("l_area"))})
    cells = pool.groupBy(*match, "p_ci", "p_cj", "bucket").agg(F.count("*").alias("n"))
    has_area = F.coalesce(F.col("q_area") > 0, F.lit(False))
    low, high = F.col("q_area") * F.lit(1 - tolerance), F.col("q_area") * F.lit(1 + tolerance)
    cells = g.geometry(cells, "p_")
    to_center = haversine_km("lat", "lon", "p_clat", "p_clon")
    in_bucket = ~has_area | ((F.col("bucket") >= _area_bucket(low)) & (F.col("bucket") <= _area_bucket(high)))
    surely = ~has_area | ((F.col("bucket") > _area_bucket(low)) & (F.col("bucket") < _area_bucket(high)))
    asked = spread(asked, "q_id")
    close = Grid(radius_km, max(1.0, (crowd / per_cell) ** 0.5), "haversine", max_lat)
    reach = min(close.side, radius_km)
    tried = beside(asked.withColumn("alone", F.count("*").over(Window.partitionBy("q_id")) == 1).withColumns(close.cell("lat", "lon")),
                   pool.withColumns(close.cell("l_lat", "l_lon", "o_")), close, match,
                   ["l_lat", "l_lon", "l_area", "l_id", *[c for c in pool.columns if c.startswith("__")]])
    fits = F.filter("near", lambda x: (F.abs(x["l_lat"] - F.col("lat")) <= close.step_lat * 1.001)
                    & (~has_area | x["l_area"].between(low, high))
                    & (geodesic_m("lat", "lon", x["l_lat"], x["l_lon"]) <= reach * 1000.0))
    # Each branch names the search once: Spark would work it out again for every mention.
    enough = 0 if reach >= radius_km else k
    ordered = F.sort_array(F.transform(fits, lambda x: F.struct(
        geodesic_m("lat", "lon", x["l_lat"], x["l_lon"]).alias("distance_m"), x["l_id"].alias("l_id"), x.alias("row"))))
    best = once(F.slice(ordered, 1, k), lambda b: F.when(F.size(b) >= enough, b))
    shown = {**{c: F.col(f"b.row.__{c}") for c in carry}, **{c: F.col(c) for c in match},
             "lat": F.col("b.row.l_lat"), "lon": F.col("b.row.l_lon"), "area_sqm": F.col("b.row.l_area")}
    at_hand = (tried.filter("alone AND near IS NOT NULL").select("q_id", *match, F.posexplode(best).alias("at", "b"))
               .select("q_id", F.col("b.l_id").alias("l_id"), F.col("b.distance_m").alias("distance_m"),
                       *[shown[c].alias(c) for c in carry], (F.col("at") + 1).alias("rank")))
    settled = F.col("alone") & F.col("near").isNotNull() & (F.size(fits) >= enough)
    asked = (tried.filter(~settled).select("q_id", *match, "lat", "lon", "q_area").withColumns(g.cell("lat", "lon")))
    asked = spread(asked, "q_id")
    # Distance that surely holds k listings: running total over the cells at hand, by
    # their farthest corner.  Looking only around the probe keeps this small; where it
    # finds fewer than k, every cell within the radius is opened.
    w = Window.partitionBy("q_id").orderBy("far").rowsBetween(Window.unboundedPreceding, 0)
    bound = (unfolded(g.around(asked, F.lit(g.side))).join(cells, [*match, "p_ci", "p_cj"]).filter(surely)
             .withColumn("far", to_center + F.col("p_half")).withColumn("so_far", F.sum("n").over(w))
             .filter(F.col("so_far") >= k).groupBy("q_id").agg(F.min("far").alias("bound")))
    limited = attach(asked, bound, ["q_id"]).withColumn(
        "bound", F.least(F.coalesce("bound", F.lit(float(radius_km))), F.lit(float(radius_km))))
    opened = (unfolded(g.around(limited, F.col("bound"))).join(cells, [*match, "p_ci", "p_cj"])
              .filter((to_center - F.col("p_half") <= F.col("bound")) & in_bucket)
              .select("q_id", *match, "lat", "lon", "q_area", "p_ci", "p_cj", "bucket"))
    found = (unfolded(opened).join(pool, [*match, "p_ci", "p_cj", "bucket"])
             .filter(~has_area | F.col("l_area").between(low, high))
             .withColumn("distance_m", geodesic_m("lat", "lon", "l_lat", "l_lon"))
             .filter(F.col("distance_m") <= radius_km * 1000.0)
             .select("q_id", "l_id", "distance_m", *[facts[c].alias(c) for c in carry]))
    return (at_hand.unionByName(top_k_per_probe(found, "q_id", ["distance_m", "l_id"], k))
            .withColumnsRenamed({"q_id": probe_id, "l_id": listing_id}))


def comparables(requests: DataFrame, listings: DataFrame, km: float = 3.0, tol: float = 0.4, k: int = 8,
                request_id: str = "request_id", listing_id: str = "doc_id",
                resolution: int | None = None, facts: Sequence[str] = ()) -> DataFrame:
    """Nearest priced listings of the same type and deal, area within the tolerance.

    Further columns of the listings that `facts` names (source, lat, lon, url, ..) follow.
    """
    priced = listings.filter(F.col("price_eur").isNotNull())
    shown = ["locality", "property_type", "area_sqm", "price_eur"]
    near = nearest_within(requests, priced, request_id, listing_id, km, k,
                          ("property_type", "listing_type"), tol, resolution, [*shown, *facts])
    return near.select(
        request_id, "rank", listing_id, "locality", "property_type", "area_sqm", "price_eur",
        F.when(F.col("area_sqm") > 0, round_even(F.col("price_eur") / F.col("area_sqm"), 2)).alias("price_per_sqm"),
        round_even("distance_m", 0).alias("distance_m"), *facts)


def comparables_api(requests: DataFrame, listings: DataFrame, km: float = 2.0, tol: float = 0.3, k: int = 10,
                    request_id: str = "request_id", listing_id: str = "id",
                    resolution: int | None = None, facts: Sequence[str] = ()) -> DataFrame:
    """Same country and type, adjusted price known, nearest ten within two kilometres.

    Further columns of the listings that `facts` names (address, date, source, ..) follow.
    """
    priced = listings.filter(F.col("price_adjusted_eur").isNotNull())
    near = nearest_within(requests, priced, request_id, listing_id, km, k,
                          ("country", "property_type"), tol, resolution, ["area_sqm", "price_adjusted_eur", *facts])
    price = F.col("price_adjusted_eur")
    per_sqm = F.when((F.col("area_sqm") != 0) & (price != 0), price / F.col("area_sqm")).otherwise(0.0)
    return near.select(
        request_id, "rank", listing_id, "area_sqm", price.alias("price_eur"),
        round_even(per_sqm, 2).alias("price_per_sqm"), round_even("distance_m", 1).alias("distance_m"), *facts)


# --- Scored nearest rentals ------------------------------------------------------------------

_ALIKE = 800         # rentals in the first circle around a sale


def similar_rentals(sales: DataFrame, rentals: DataFrame, max_km: float = 5.0, k: int = 3,
                    sale_id: str = "doc_id", rental_id: str = "doc_id", resolution: int | None = None) -> DataFrame:
    """The k most alike rentals near each sale: distance, rooms, area and condition.

    Columns rooms, area_sqm, condition may be NULL on either side.  Sales are searched tile by tile
    (`tiles`): k rentals that score less than any rental farther off can settle a sale; the others
    look within `max_km`.
    """
    def known(c):
        return F.when(F.col(c) != 0, F.col(c))

    located = F.col("lat").isNotNull() & F.col("lon").isNotNull() & (F.col("lat") != 0) & (F.col("lon") != 0)
    usable = rentals.filter(located & (F.col("price_eur") > 0))
    if resolution is None:  # a first circle with about `_ALIKE` rentals
        resolution = (crowding(usable, max_km, "planar") * math.pi / _ALIKE) ** 0.5
    pool = (usable.select(F.col(rental_id).alias("r_id"), F.col("lat").cast("double").alias("p_lat"), F.col("lon").cast("double").alias("p_lon"),
                          *[known(c).cast("double").alias(f"r_{n}") for c, n in (("rooms", "rooms"), ("area_sqm", "area"), ("condition", "cond"))],
                          F.col("price_eur").alias("r_price"))
            # Rentals alike in all that scores rank by id, so only the k lowest ids can be chosen.
            .withColumn("r", F.row_number().over(
                Window.partitionBy("p_lat", "p_lon", "r_rooms", "r_area", "r_cond").orderBy("r_id")))
            .filter(F.col("r") <= k).drop("r"))
    # Sales that look alike get one search between them.
    alike = Window.partitionBy(*tiles.LOOKS)
    asked = (sales.filter(located)
             .select(F.col(sale_id).alias("q_id"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"),
                     *[known(c).cast("double").alias(f"q_{n}") for c, n in (("rooms", "rooms"), ("area_sqm", "area"), ("condition", "cond"))])
             .withColumns({"q_key": F.min("q_id").over(alike), "__nth": F.row_number().over(alike.orderBy("q_id"))}))
    probes = asked.filter("__nth = 1 AND q_key IS NOT NULL").select("q_key", *tiles.LOOKS)
    found = tiles.most_alike(probes, pool, max_km, k, [max_km / resolution] if resolution > 2 else [], spread)
    best = top_k_per_probe(found, "q_key", ["similarity", "r_id"], k)
    return asked.select("q_id", "q_key").join(best, "q_key").select(
        F.col("q_id").alias("sale_id"), "rank", F.col("r_id").alias("rental_id"),
        F.col("r_price").alias("rent_eur"), "dist_km", "similarity")


# --- Nearest point of each category --------------------------------------------------------------

_FINE = 0.01          # degrees, finest cell of the nearest-point search
_LEVELS = 16          # each level doubles the cell; the last covers the globe


def _fine_cell(lat: str, lon: str) -> dict[str, Column]:
    return {"ci": F.floor(F.col(lat) / _FINE).cast("long"), "cj": F.floor(F.col(lon) / _FINE).cast("long")}


def _at_level(cell: str) -> Column:
    return F.floor(F.col(cell) / F.pow(F.lit(2.0), F.col("level"))).cast("long")


def degree_distance(lat1, lon1, lat2, lon2) -> Column:
    dy, dx = F.col(lat1) - F.col(lat2), F.col(lon1) - F.col(lon2)
    return F.sqrt(dy * dy + dx * dx)


def nearest_candidates(spots: DataFrame, points: DataFrame, category: str = "category",
                       metric: str = "haversine", by: Sequence[str] = ()) -> DataFrame:
    """For every occupied fine cell and category, the points that can be nearest to
    some position in the cell.  Works on cells, so its size follows the map, not
    the number of listings.  Cells only look at points that agree in the `by` columns.
    Returns (by.., ci, cj, category, p_lat, p_lon)."""
    by = list(by)
    cells = spots.withColumns(_fine_cell("lat", "lon")).select(*by, "ci", "cj").distinct()
    clat, clon = (F.col("ci") + 0.5) * _FINE, (F.col("cj") + 0.5) * _FINE
    if metric == "haversine":
        edge = F.greatest(F.abs(clat) - _FINE / 2, F.lit(0.0))
        half = haversine_km(F.abs(clat), clon * 0, edge, clon * 0 + F.lit(_FINE / 2)) * 1.000001 + 1e-9
        to_point = haversine_km("clat", "clon", "p_lat", "p_lon")
        away = F.cos(F.radians(F.least(F.abs(F.col("clat")) + _FINE, F.lit(89.0))))
        side, far = F.lit(_FINE * KM_PER_DEGREE * 0.98) * away, 2000.0
    else:
        half = F.lit(_FINE * 0.7072)
        to_point = degree_distance("clat", "clon", "p_lat", "p_lon")
        side, far = F.lit(_FINE), 1e9
    cells = spread(cells, "ci", "cj").withColumns({"clat": clat, "clon": clon, "half": half})
    levels = F.explode(F.sequence(F.lit(0), F.lit(_LEVELS - 1)))
    block = {"ai": _at_level("ci"), "aj": _at_level("cj")}

    def three_by_three(blocks: DataFrame) -> DataFrame:
        near3 = F.array(F.lit(-1), F.lit(0), F.lit(1))
        return (blocks.withColumn("ai", F.explode(F.transform(near3, lambda d: F.col("ai") + d)))
                .withColumn("aj", F.explode(F.transform(near3, lambda d: F.col("aj") + d))))

    # Each point stands in its own block at every level; cells look at the 3 x 3 blocks around theirs.
    placed = (points.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
              .select(*by, F.col(category).alias("category"), F.col("lat").alias("p_lat"), F.col("lon").alias("p_lon"))
              .distinct().withColumns(_fine_cell("p_lat", "p_lon")))
    marks = unfolded(placed.withColumn("level", levels).withColumns(block).select(*by, "category", "p_lat", "p_lon", "level", "ai", "aj"))
    held = (placed.select(*by, "category", "ci", "cj").distinct().withColumn("level", levels).withColumns(block)
            .select(*by, "category", "level", "ai", "aj").distinct())
    occupied = unfolded(three_by_three(held).distinct())
    first = (unfolded(cells.withColumn("level", levels).withColumns(block))
             .join(occupied, [*by, "level", "ai", "aj"]).groupBy(*by, "ci", "cj", "category")
             .agg(F.min_by(F.struct("level", "ai", "aj", "clat", "clon", "half"), "level").alias("f"))
             .select(*by, "ci", "cj", "category", "f.*"))
    # The best point of the first occupied block bounds the distance from the cell.
    reach = (unfolded(three_by_three(first)).join(marks, [*by, "category", "level", "ai", "aj"])
             .groupBy(*by, "ci", "cj", "category", "clat", "clon", "half").agg(F.min(to_point).alias("d0"))
             .withColumn("reach", F.col("d0") + F.col("half") * 2))
    # Smallest level whose 3 x 3 block surely covers that reach around the centre.
    level = F.ceil(F.log2(F.greatest((F.col("reach") + F.col("half")) / side, F.lit(1.0)))).cast("int")
    level = F.when(F.col("reach") > far, F.lit(_LEVELS - 1)).otherwise(F.least(level, F.lit(_LEVELS - 1)))
    return (unfolded(three_by_three(reach.withColumn("level", level).withColumns(block)))
            .join(marks, [*by, "category", "level", "ai", "aj"])
            .filter(to_point <= F.col("reach"))
            .select(*by, "ci", "cj", "category", "p_lat", "p_lon"))


def nearest_poi(df: DataFrame, pois: DataFrame, category_map: Mapping[str, Sequence[str]] | None = None,
                method: str = "haversine", country: str | None = None) -> DataFrame:
    """Adds one distance column per feature: kilometres to the nearest point of its
    categories, NULL when there is none.

    With `country`, a column of `df`, only points of the same country count.
    `method="degree"` gives the older figure, degrees times 100.4.
    """
    feature_map = V.POI_DISTANCE_FEATURES if category_map is None else category_map
    named = F.create_map(*[F.lit(x) for f, cats in feature_map.items() for c in cats for x in (c, f)])
    pts = pois.withColumn("feature", F.try_element_at(named, F.col("category"))).filter("feature IS NOT NULL")
    keys = [country] if country else []
    if country:
        pts = pts.withColumnRenamed("country", country)
    spots = (df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
             .select("lat", "lon", *keys).distinct())
    candidates = nearest_candidates(spots, pts, "feature", method, keys)
    dist = degree_distance("lat", "lon", "p_lat", "p_lon") * F.lit(V.DEG_TO_KM) if method == "degree" \
        else haversine_km("lat", "lon", "p_lat", "p_lon")
    best = (spread(spots.withColumns(_fine_cell("lat", "lon")), *keys, "ci", "cj").join(candidates, [*keys, "ci", "cj"])
            .groupBy("lat", "lon", *keys).agg(*[
                round_even(F.min(F.when(F.col("category") == f, dist)), 3).alias(f) for f in feature_map]))
    return attach(df, best, ["lat", "lon", *keys])
