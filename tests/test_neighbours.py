"""Nearest neighbours where stations stand close, at poles and across the date line, against all pairs."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugemark.functions.geo import EARTH_RADIUS_KM
from gaugemark.operators import geo


def brute(ids, lat, lon, k, radius):
    """All pairs by the haversine formula; (distance, id) decides."""
    a, b = np.radians(lat), np.radians(lon)
    h = np.sin((a[:, None] - a) / 2) ** 2 + np.cos(a[:, None]) * np.cos(a) * np.sin((b[:, None] - b) / 2) ** 2
    d = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
    out = {}
    for n, i in enumerate(ids):
        order = sorted((round(d[n, m], 9), j) for m, j in enumerate(ids) if m != n and d[n, m] <= radius)
        out[i] = order[:k]
    return out


def frame(spark, lat, lon):
    ids = [f"s{i:05d}" for i in range(len(lat))]
    return ids, spark.createDataFrame(pd.DataFrame({"station_id": ids, "lat": lat, "lon": lon, "status": "included"}))


@pytest.mark.parametrize("where", ["dense", "mixed", "pole", "dateline"])
@pytest.mark.parametrize("levels", [1, 4, 6])
def test_neighbours_are_those_of_all_pairs(spark, where, levels):
    r = np.random.default_rng(4)
    n = 300
    lat = {"dense": -30 + r.uniform(0, 0.5, n), "mixed": np.where(r.random(n) < 0.6, -30 + r.normal(0, 0.02, n), r.uniform(-35, -25, n)), "pole": r.uniform(87, 90, n), "dateline": r.uniform(-2, 2, n)}[where]
    lon = {"dense": -51 + r.uniform(0, 0.5, n), "mixed": -51 + r.normal(0, 0.3, n), "pole": r.uniform(-180, 180, n), "dateline": (180 + r.uniform(-2, 2, n) + 180) % 360 - 180}[where]
    lat, lon = np.round(lat, 2 if where == "dense" else 5), np.round(lon, 2 if where == "dense" else 5)  # stations of one place, ties
    ids, df = frame(spark, lat, lon)
    got = {}
    for x in geo.knn_pairs(df, 5, 300.0, levels).collect():
        got.setdefault(x["station_id"], []).append((round(x["dist_km"], 9), x["neighbor_id"]))
    for i, want in brute(ids, lat, lon, 5, 300.0).items():
        have = sorted(got.get(i, []))
        assert [d for d, _ in have] == pytest.approx([d for d, _ in want], abs=1e-6)
        far = want[-1][0] if want else 0
        assert {j for d, j in have if d < far - 1e-6} == {j for d, j in want if d < far - 1e-6}


def test_close_stations_do_not_meet_all(spark):
    """20,000 places in a degree: a place meets hundreds of others, not all."""
    r = np.random.default_rng(5)
    n = 20_000
    _, df = frame(spark, -30 + r.uniform(0, 1, n), -51 + r.uniform(0, 1, n))
    places = geo._placed(df)[1]
    looking = geo._search_radius(places, 5, 300.0, 4)
    levels = {x["level"]: x["count"] for x in looking.groupBy("level").count().collect()}
    assert set(levels) <= {1, 2, 3} and levels[3] > 0.95 * n
    met = sum(geo.near_pairs(looking.where(F.col("level") == l), places, 300.0 / 4**l).count() for l in levels)
    assert met < 0.02 * n * n
    assert geo.knn_pairs(df).count() == 5 * n
