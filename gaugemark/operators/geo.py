"""Operators on station positions and regular grids.

Pairs of stations within a distance are found over a grid of cells: every station is dealt to its own
and the neighbouring cells and joined by cell, so no cross join is made and far stations never meet.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.geo import EARTH_RADIUS_KM, RES, cell, haversine_km

_KM_PER_DEGREE = EARTH_RADIUS_KM * math.pi / 180


def near_pairs(left: DataFrame, right: DataFrame, max_km: float) -> DataFrame:
    """(id_l, id_r, dist_km) of all pairs within ``max_km``; inputs (station_id, lat, lon), nulls take no part.

    Bands of latitude bound the search; a band is as high as the distance, so three bands suffice.
    Longitude cells are as wide as the distance at the band's edge nearest to a pole.
    """
    height = max_km / _KM_PER_DEGREE
    rows = int(180 / height) + 2

    def columns_in(band):  # how many longitude cells a band has
        edge = F.least(F.lit(90.0), F.greatest(F.abs(band * height - 90), F.abs((band + 1) * height - 90)) + height)
        return F.greatest(F.lit(1), F.floor(F.lit(360.0) * F.cos(F.radians(edge)) / height).cast("int"))

    band = lambda lat: F.floor((lat + 90) / height).cast("int")
    column = lambda lon, b: F.floor(F.pmod(lon, F.lit(360.0)) / 360.0 * columns_in(b)).cast("int")
    l = left.where("lat is not null and lon is not null").select(F.col("station_id").alias("id_l"), F.col("lat").alias("lat_l"), F.col("lon").alias("lon_l"))
    r = right.where("lat is not null and lon is not null").select(F.col("station_id").alias("id_r"), F.col("lat").alias("lat_r"), F.col("lon").alias("lon_r"))
    r = r.withColumn("b", band(F.col("lat_r"))).withColumn("c", column(F.col("lon_r"), F.col("b")))
    l = l.withColumn("b", F.explode(F.array(*(band(F.col("lat_l")) + i for i in (-1, 0, 1))))).where((F.col("b") >= 0) & (F.col("b") <= rows))
    around = F.array_distinct(F.array(*(F.pmod(column(F.col("lon_l"), F.col("b")) + i, columns_in(F.col("b"))) for i in (-1, 0, 1))))
    pairs = l.withColumn("c", F.explode(around)).join(r, ["b", "c"])
    distance = haversine_km(F.col("lat_l"), F.col("lon_l"), F.col("lat_r"), F.col("lon_r"))
    return pairs.withColumn("dist_km", distance).where(F.col("dist_km") <= max_km).select("id_l", "id_r", "dist_km")


def _placed(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stations with positions and their ``place``, and the distinct places as near_pairs takes them: stations of one place meet others once."""
    at = stations.where("lat is not null and lon is not null").select("station_id", "lat", "lon", F.concat_ws(",", F.col("lat").cast("string"), F.col("lon").cast("string")).alias("place"))
    return at, at.groupBy("place").agg(F.first("lat").alias("lat"), F.first("lon").alias("lon"), F.count(F.lit(1)).alias("n")).withColumnRenamed("place", "station_id")  # all rows of a place are alike


def _search_radius(places: DataFrame, k: int, radius_km: float, levels: int, among: DataFrame | None = None) -> DataFrame:
    """``places`` with ``level``: a cell of the level's radius across, around the place, holds k other stations, so no near neighbour is farther.

    Level 0 is the whole radius, each next one a quarter of it; the finest that suffices is taken. With ``among``, places of
    other stations, the cell holds k of theirs.
    """
    side = [radius_km / 4**l / math.sqrt(2) * 0.999 / _KM_PER_DEGREE for l in range(levels)]  # in degrees of latitude

    def cell_of(l: int):
        band = F.floor((F.col("lat") + 90) / side[l])
        equatorward = F.least(F.abs(band * side[l] - 90), F.abs((band + 1) * side[l] - 90))
        wide = F.lit(side[l]) / F.greatest(F.cos(F.radians(equatorward)), F.lit(1e-6))  # where a band is widest
        return F.struct(F.lit(l).alias("level"), band.alias("b"), F.floor(F.pmod("lon", F.lit(360.0)) / wide).alias("c"))

    fine = [cell_of(l) for l in range(1, levels)]
    if not fine:
        return places.withColumn("level", F.lit(0))
    deal = lambda at: at.select("station_id", "n", F.explode(F.array(*fine)).alias("x")).select("station_id", "n", "x.*")
    least = k + 1 if among is None else k  # a place's own station does not count
    full = deal(places if among is None else among).groupBy("level", "b", "c").agg(F.sum("n").alias("m")).where(F.col("m") >= least).select("level", "b", "c")
    best = deal(places).join(full, ["level", "b", "c"]).groupBy("station_id").agg(F.max("level").alias("level"))
    return places.join(best, "station_id", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def _levels_met(looking: DataFrame, places: DataFrame, radius_km: float, levels: int) -> DataFrame:
    """``near_pairs`` of every place with those within its level's radius."""
    return reduce(DataFrame.unionByName, (near_pairs(looking.where(F.col("level") == l), places, radius_km / 4**l) for l in range(levels)))


def knn_pairs(stations: DataFrame, k: int = 5, radius_km: float = 300.0, levels: int = 4) -> DataFrame:
    """(station_id, neighbor_id, dist_km): the k nearest included stations within the radius, ties to the smaller id.

    Of a place no more than its k + 1 smallest ids can be near neighbours of anyone, so places meet, with these ids only. Where
    stations stand close, a place looks no farther than a small cell that holds enough of them; the result is the same.
    """
    at, places = _placed(stations.where("status = 'included'"))
    first = F.row_number().over(W.partitionBy("place").orderBy("station_id"))
    ids = at.select("place", "station_id", first.alias("nth")).where(F.col("nth") <= k + 1).select(F.col("place").alias("id_r"), F.col("station_id").alias("neighbor_id"))
    looking = _search_radius(places, k, radius_km, levels)
    near = _levels_met(looking, places, radius_km, levels).join(ids, "id_r")
    best = F.row_number().over(W.partitionBy("id_l").orderBy("dist_km", "neighbor_id"))
    near = near.withColumn("rank", best).where(F.col("rank") <= k + 1).select(F.col("id_l").alias("place"), "neighbor_id", "dist_km", "rank")
    pairs = at.select("station_id", "place").join(near, "place").where("station_id <> neighbor_id")
    rank = F.row_number().over(W.partitionBy("station_id").orderBy("rank"))
    return pairs.withColumn("nth", rank).where(F.col("nth") <= k).select("station_id", "neighbor_id", "dist_km")


def _nearest_other(of: DataFrame, among: DataFrame, max_km: float, name: str, levels: int = 3) -> DataFrame:
    """(station_id, ``name``): of the stations ``among`` the nearest within ``max_km``, ties to the smaller id.

    Stations of one place have the same nearest one and a place answers with its smallest id, so places meet, not stations.
    """
    (at, places), (others, other_places) = _placed(of), _placed(among)
    first = others.groupBy(F.col("place").alias("id_r")).agg(F.min("station_id").alias("other"))
    met = _levels_met(_search_radius(places, 1, max_km, levels, other_places), other_places, max_km, levels)
    best = met.join(first, "id_r").groupBy(F.col("id_l").alias("place")).agg(F.min(F.struct("dist_km", "other")).alias("x"))
    return at.join(best, "place").groupBy("station_id").agg(F.min("x").alias("x")).select("station_id", F.col("x.other").alias(name))


def dedupe_networks(stations: DataFrame, max_km: float = 2.0, primary: str = "inmet", secondary: str = "isd") -> DataFrame:
    """Of included stations of two networks within ``max_km``: the secondary one is excluded, each refers to its nearest."""
    kept = stations.where("status = 'included'")
    first, second = (kept.where(F.col("network") == name) for name in (primary, secondary))
    dup, ref = _nearest_other(second, first, max_km, "_dup"), _nearest_other(first, second, max_km, "_ref")
    out = stations.join(dup, "station_id", "left").join(ref, "station_id", "left")
    is_dup = F.col("_dup").isNotNull()
    return out.withColumns({
        "status": F.when(is_dup, F.lit("excluded")).otherwise(F.col("status")),
        "exclusion_reason": F.when(is_dup, F.concat(F.lit("duplicate_of:"), F.col("_dup"))).otherwise(F.col("exclusion_reason")),
        "cross_ref": F.coalesce("_dup", "_ref", "cross_ref"),
    }).select(stations.columns)


def with_cells(stations: DataFrame, res: float = RES) -> DataFrame:
    return stations.withColumns({"cell_lat": cell(F.col("lat"), res), "cell_lon": cell(F.col("lon"), res)})


def shared_cells(stations: DataFrame, least: int = 2, res: float = RES) -> DataFrame:
    """One row: the number of cells with ``least`` included stations or more."""
    counts = with_cells(stations.where("status = 'included' and lat is not null and lon is not null"), res).groupBy("cell_lat", "cell_lon").agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count_if(F.col("n") >= least).alias("n_cells"))


def density_weights(stations: DataFrame, alpha0_deg: float = 0.75) -> DataFrame:
    """(station_id, weight): 1 / sum of exp(-(angle / alpha0)^2) over all stations, itself too, scaled to mean 1.

    Terms below double precision (angles over 6.1 alpha0) are left out, so near pairs suffice.
    """
    if alpha0_deg <= 0:
        raise ValueError("alpha0_deg must be positive")
    checks = stations.agg(F.count_if(F.col("lat").isNull() | F.col("lon").isNull()).alias("nulls"), F.count("station_id").alias("n"), F.count_distinct("station_id").alias("ids")).first()
    if checks["nulls"] or checks["n"] != checks["ids"]:
        raise ValueError("density weights need positions and unique ids")
    at, places = _placed(stations)
    pairs = near_pairs(places, places, 6.1 * alpha0_deg * _KM_PER_DEGREE).join(places.select(F.col("station_id").alias("id_r"), "n"), "id_r")
    angle = F.degrees(F.col("dist_km") / EARTH_RADIUS_KM)
    by_place = pairs.groupBy(F.col("id_l").alias("place")).agg((1 / F.sum(F.col("n") * F.exp(-F.pow(angle / alpha0_deg, F.lit(2.0))))).alias("w"))
    raw = at.select("station_id", "place").join(by_place, "place").select("station_id", "w")
    mean = raw.agg(F.avg("w").alias("mean"))  # one row
    return raw.join(F.broadcast(mean)).select("station_id", (F.col("w") / F.col("mean")).alias("weight"))


def clip_bbox(stations: DataFrame, lat: tuple[float, float] = (-34.0, 6.0), lon: tuple[float, float] = (-74.0, -32.0)) -> DataFrame:
    """Included stations outside the box or without a position become excluded; earlier causes stay."""
    reason = F.when(F.col("lat").isNull() | F.col("lon").isNull(), F.lit("invalid_coords")).when(~(F.col("lat").between(*lat) & F.col("lon").between(*lon)), F.lit("outside_bbox"))
    return _excluded(stations, reason)


def exclude_network(stations: DataFrame, network: str, reason: str) -> DataFrame:
    return _excluded(stations, F.when(F.col("network") == network, F.lit(reason)))


def review_elevation(stations: DataFrame, max_diff_m: float = 100.0) -> DataFrame:
    """Included stations whose height is more than ``max_diff_m`` off the terrain model's go to review."""
    return _excluded(stations, F.when(F.abs(F.col("elev_station") - F.col("elev_dem")) > max_diff_m, F.lit(f"elev_diff_gt_{max_diff_m:g}m")), "review")


def _excluded(stations: DataFrame, reason, status: str = "excluded") -> DataFrame:
    now = (F.col("status") == "included") & reason.isNotNull()
    return stations.withColumns({"exclusion_reason": F.when(now, reason).otherwise(F.col("exclusion_reason")), "status": F.when(now, F.lit(status)).otherwise(F.col("status"))})


def _brackets(at: DataFrame, axis: DataFrame, number: str, name: str, value: str) -> DataFrame:
    """(station_id, value, lower line, upper line) of the axis' interval that holds each value; values beyond the axis give none.

    Lines and values meet by whole degrees, so a station is compared with the lines of its degree only.
    """
    order = W.orderBy(name)  # one row for each grid line
    lines = axis.select(F.col(number).alias("n0"), F.col(name).alias("v0"), F.lead(number).over(order).alias("n1"), F.lead(name).over(order).alias("v1"))
    lines = lines.withColumn("degree", F.explode(F.sequence(F.floor("v0"), F.floor(F.coalesce("v1", "v0")))))
    inside = (F.col(value) >= F.col("v0")) & (F.col(value) < F.col("v1")) | (F.col(value) == F.col("v0")) & F.col("v1").isNull()
    return at.withColumn("degree", F.floor(value)).join(lines, "degree").where(inside).drop("degree")


def _axes(grid: DataFrame) -> tuple[DataFrame, DataFrame]:
    return grid.select("j", "lat").distinct(), grid.select("i", "lon").distinct()


def _on_grid(stations: DataFrame, grid: DataFrame, outside: str) -> DataFrame:
    """(station_id, y, x) of stations within the grid's lines, x in the longitudes that the grid itself uses.

    A grid may run from 0 to 360 or across Greenwich from negative to positive; a station's longitude is turned by 360
    degrees if that brings it between the lines. Those beyond them are left out, or raise.
    """
    if outside not in ("drop", "raise"):
        raise ValueError("outside must be drop or raise")
    ends = grid.agg(*(f(c).alias(f"{n}_{c}") for c in ("lat", "lon") for n, f in (("low", F.min), ("high", F.max))))  # one row
    at = stations.where("lat is not null and lon is not null").select("station_id", F.col("lat").alias("y"), F.col("lon").alias("lon")).join(F.broadcast(ends))
    within = lambda x: F.when(x.between(F.col("low_lon"), F.col("high_lon")), x)
    x = F.coalesce(*(within(F.col("lon") + turn) for turn in (0, 360, -360)))
    x = F.when(F.col("y").between(F.col("low_lat"), F.col("high_lat")), x)
    if outside == "raise":
        x = F.coalesce(x, F.raise_error(F.concat(F.lit("outside the grid: "), F.col("station_id").cast("string"))).cast("double"))
    return at.select("station_id", "y", x.alias("x")).where("x is not null")


def grid_weights(stations: DataFrame, grid: DataFrame, outside: str = "raise") -> DataFrame:
    """(station_id, j, i, weight): up to four bilinear corners on a regular grid (j, i, lat, lon).

    Latitudes may fall or rise. A corner of weight zero is left out. Points beyond the grid raise when the result is
    computed, or give none with ``outside="drop"``; so do points in a gap between the last and the first longitude.
    """
    lats, lons = _axes(grid)
    at = _on_grid(stations, grid, outside)

    def ends(axis: DataFrame, number: str, name: str, value: str) -> DataFrame:
        share = F.coalesce((F.col(value) - F.col("v0")) / (F.col("v1") - F.col("v0")), F.lit(0.0))
        two = F.array(F.struct(F.col("n0").alias("at"), (1 - share).alias("w")), F.struct(F.col("n1").alias("at"), share.alias("w")))
        found = _brackets(at.select("station_id", value), axis, number, name, value).select("station_id", F.explode(two).alias("e")).where("e.w > 0")
        return found.select("station_id", F.col("e.at").alias(number), F.col("e.w").alias(f"w{number}"))

    return ends(lats, "j", "lat", "y").join(ends(lons, "i", "lon", "x"), "station_id").select("station_id", "j", "i", (F.col("wj") * F.col("wi")).alias("weight"))


def bilinear(weights: DataFrame, grid: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Interpolated values by station and ``keys``; null where a corner is missing."""
    corners = weights.groupBy("station_id").agg(F.count(F.lit(1)).alias("corners"))
    summed = grid.join(weights, ["j", "i"]).groupBy("station_id", *keys).agg(F.sum(F.col("weight") * F.col(value)).alias("s"), F.count(value).alias("n"))
    return summed.join(corners, "station_id").select("station_id", *keys, F.when(F.col("n") == F.col("corners"), F.col("s")).alias(value))


def nearest_nodes(stations: DataFrame, grid: DataFrame, outside: str = "raise") -> DataFrame:
    """(station_id, j, i): on each axis the nearest line, ties to the lower index; points beyond the grid as in ``grid_weights``."""
    lats, lons = _axes(grid)
    at = _on_grid(stations, grid, outside)

    def pick(axis: DataFrame, number: str, name: str, value: str) -> DataFrame:
        away = lambda v, n: F.struct(F.abs(F.col(value) - F.col(v)), F.col(n))
        second = F.col("n1").isNotNull() & (away("v1", "n1") < away("v0", "n0"))
        return _brackets(at.select("station_id", value), axis, number, name, value).select("station_id", F.when(second, F.col("n1")).otherwise(F.col("n0")).alias(number))

    return pick(lats, "j", "lat", "y").join(pick(lons, "i", "lon", "x"), "station_id")
