"""Distances as Column expressions."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from parcelgrid import fixed_values as V
from parcelgrid.functions.common import col, round_even


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    lat1, lon1, lat2, lon2 = (col(c) for c in (lat1, lon1, lat2, lon2))
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    a = half_lat * half_lat + (F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
                               * half_lon * half_lon)
    return F.lit(2 * V.EARTH_RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    dy = (col(lat1) - col(lat2)) * F.lit(V.PLANAR_LAT_KM)
    dx = (col(lon1) - col(lon2)) * F.lit(V.PLANAR_LON_KM)
    return F.sqrt(dy * dy + dx * dx)


def geodesic_m(lat1, lon1, lat2, lon2) -> Column:
    """Metres on the sphere; within 0.5 % of the ellipsoid."""
    return haversine_km(lat1, lon1, lat2, lon2) * F.lit(1000.0)


def poi_distance_train(lat, lon, poi_lat, poi_lon) -> Column:
    dy, dx = col(lat) - col(poi_lat), col(lon) - col(poi_lon)
    return F.sqrt(dy * dy + dx * dx) * F.lit(V.DEG_TO_KM)


def _segment_distance(lat: Column, lon: Column, start, end) -> Column:
    (x1, y1), (x2, y2) = start, end
    dx, dy = x2 - x1, y2 - y1
    length2 = dx * dx + dy * dy
    along = ((lon - F.lit(x1)) * F.lit(dx) + (lat - F.lit(y1)) * F.lit(dy)) / F.lit(length2)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    ex = lon - (F.lit(x1) + t * F.lit(dx))
    ey = lat - (F.lit(y1) + t * F.lit(dy))
    return F.sqrt(ex * ex + ey * ey)


def coast_distance_train(lat, lon) -> Column:
    """Distance to the coast rings in degrees, scaled by 100 to rough kilometres."""
    lat, lon = col(lat), col(lon)
    segments = [_segment_distance(lat, lon, a, b)
                for ring in V.COAST_RINGS for a, b in zip(ring, ring[1:])]
    return round_even(F.least(*segments) * F.lit(100.0), 3)


def coast_distance_serve(lat, lon) -> Column:
    points = [haversine_km(lat, lon, F.lit(a), F.lit(b)) for a, b in V.COAST_POINTS]
    return round_even(F.least(*points), 3)


def cbd_distance(lat, lon) -> Column:
    return round_even(haversine_km(lat, lon, F.lit(V.CBD[0]), F.lit(V.CBD[1])), 3)


def key_location_distances(lat, lon, country) -> dict[str, Column]:
    """One distance column per named place; NULL outside the place's country."""
    out = {}
    for code, places in V.KEY_LOCATIONS.items():
        for name, (plat, plon) in places.items():
            d = round_even(haversine_km(lat, lon, F.lit(plat), F.lit(plon)), 3)
            out[f"dist_{name}_km"] = F.when(col(country) == code, d)
    return {name: out[name] for name in sorted(out)}


def key_location_distance(df, country="country", lat="lat", lon="lon"):
    return df.withColumns(key_location_distances(lat, lon, country))


KM_PER_DEGREE = math.radians(1.0) * V.EARTH_RADIUS_KM
