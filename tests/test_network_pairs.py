"""Stations of two networks: the nearest of the other one, against all pairs; stations of one place meet others once."""

import numpy as np
import pandas as pd
import pytest

from gaugemark.functions.geo import EARTH_RADIUS_KM
from gaugemark.operators import geo


def frame(spark, lat, lon, network, status="included"):
    rows = pd.DataFrame({"station_id": [f"s{i:05d}" for i in range(len(lat))], "network": network, "lat": lat, "lon": lon, "status": status})
    return rows, spark.createDataFrame(rows).selectExpr("*", "CAST(NULL AS string) AS exclusion_reason", "CAST(NULL AS string) AS cross_ref")


def brute(rows, radius):
    """station_id -> (distance, ids of the other network's stations at it)."""
    out = {}
    kept = rows[rows["status"] == "included"]
    for a, b in (("isd", "inmet"), ("inmet", "isd")):
        others = kept[kept["network"] == b]
        for r in kept[kept["network"] == a].itertuples():
            la, lo = np.radians(others["lat"].to_numpy()), np.radians(others["lon"].to_numpy())
            h = np.sin((la - np.radians(r.lat)) / 2) ** 2 + np.cos(la) * np.cos(np.radians(r.lat)) * np.sin((lo - np.radians(r.lon)) / 2) ** 2
            d = 2 * EARTH_RADIUS_KM * np.arcsin(np.sqrt(np.minimum(1, h)))
            if len(d) and d.min() <= radius:
                out[r.station_id] = sorted(others["station_id"][d <= d.min() + 1e-7])
    return out


@pytest.mark.parametrize("where", ["dense", "mixed", "pole", "dateline"])
def test_nearest_of_the_other_network(spark, where):
    r = np.random.default_rng(6)
    n = 400
    lat = {"dense": -30 + r.uniform(0, 0.3, n), "mixed": np.where(r.random(n) < 0.6, -30 + r.normal(0, 0.02, n), r.uniform(-35, -25, n)), "pole": r.uniform(88, 90, n), "dateline": r.uniform(-2, 2, n)}[where]
    lon = {"dense": -51 + r.uniform(0, 0.3, n), "mixed": -51 + r.normal(0, 0.3, n), "pole": r.uniform(-180, 180, n), "dateline": (180 + r.uniform(-2, 2, n) + 180) % 360 - 180}[where]
    lat, lon = np.round(lat, 2 if where == "dense" else 5), np.round(lon, 2 if where == "dense" else 5)
    rows, df = frame(spark, lat, lon, np.where(r.random(n) < 0.5, "inmet", "isd"), np.where(r.random(n) < 0.1, "review", "included"))
    want = brute(rows, 40.0)
    networks = dict(zip(rows["station_id"], rows["network"], strict=True))
    for x in geo.dedupe_networks(df, 40.0).collect():
        near = want.get(x["station_id"])
        dup = near is not None and networks[x["station_id"]] == "isd"
        assert (x["cross_ref"] is None) == (near is None) and (near is None or x["cross_ref"] in near)
        assert x["exclusion_reason"] == (f"duplicate_of:{x['cross_ref']}" if dup else None) and (x["status"] == "excluded") == dup


def test_stations_of_one_place_meet_once(spark, monkeypatch):
    """600 stations at two places a kilometre apart, each of either network: ties to the smaller id, four pairs of places a direction."""
    n, met, plain = 600, [], geo.near_pairs
    monkeypatch.setattr(geo, "near_pairs", lambda *args: met.append(plain(*args)) or met[-1])
    at = np.arange(n) % 2
    _, df = frame(spark, -30 + at * 0.009, np.full(n, -51.0), np.where(np.arange(n) % 4 < 2, "inmet", "isd"))
    got = {x["station_id"]: x["cross_ref"] for x in geo.dedupe_networks(df).collect()}
    first = {("isd", 0): "s00000", ("isd", 1): "s00001", ("inmet", 0): "s00002", ("inmet", 1): "s00003"}
    assert got == {f"s{i:05d}": first["inmet" if i % 4 < 2 else "isd", i % 2] for i in range(n)}
    assert sum(x.count() for x in met) <= 8
