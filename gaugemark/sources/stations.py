"""Station inventories in their source forms, mapped to the STATIONS contract; no station is lost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import contracts as C
from ..functions.geo import tile as dem_tile

#: Words in a station's state that tell that it was closed.
CLOSED = ("desativ", "encerr", "extint", "fechad")


def _number(x: Column) -> Column:
    return F.replace(F.trim(x), F.lit(","), F.lit(".")).try_cast("double")


def tag_isd_history(raw: DataFrame, country: str = "BR", min_end: str = "20250701") -> DataFrame:
    """The inventory (all columns text) with lat, lon and the first reason to drop a row, in order."""
    out = raw.withColumns({"lat": F.trim("LAT").try_cast("double"), "lon": F.trim("LON").try_cast("double")})
    bad = F.col("lat").isNull() | F.col("lon").isNull() | ((F.col("lat") == 0) & (F.col("lon") == 0))
    reason = F.when(F.coalesce(F.col("CTRY") != country, F.lit(True)), "not_country").when(F.coalesce(F.col("END") < min_end, F.lit(True)), "end_before_min").when(bad, "invalid_coords")
    return out.withColumn("drop_reason", reason)


def isd_to_canonical(kept: DataFrame, ingest_version: str) -> DataFrame:
    native = F.concat_ws("-", F.trim("USAF"), F.trim("WBAN"))
    height = _number(F.col("`ELEV(M)`"))
    return _canonical(kept, {
        "station_id": F.concat(F.lit("isd:"), native), "network": F.lit("isd"), "native_id": native, "name": F.nullif(F.trim("STATION NAME"), F.lit("")),
        "lat": F.col("lat"), "lon": F.col("lon"), "elev_station": F.when((height > -900) & (height < 9000), height), "status": F.lit("included"),
        "source_meta": F.format_string("ncei:isd-history.csv begin=%s end=%s", "BEGIN", "END"), "ingest_version": F.lit(ingest_version),
    })


def inmet_to_canonical(records: DataFrame, ingest_version: str, inactive_end_cutoff: str | None = None) -> DataFrame:
    """Station records (text columns) with closed stations excluded as inactive."""
    state = F.coalesce(F.trim("CD_SITUACAO"), F.lit(""))
    end = F.substring(F.coalesce(F.trim("DT_FIM_OPERACAO"), F.lit("")), 1, 10)
    closed = F.lower(state).rlike("|".join(CLOSED))
    if inactive_end_cutoff:
        closed |= (end != "") & (end < inactive_end_cutoff)
    native = F.trim("CD_ESTACAO")
    return _canonical(records, {
        "station_id": F.concat(F.lit("inmet:"), native), "network": F.lit("inmet"), "native_id": native, "name": F.nullif(F.trim("DC_NOME"), F.lit("")), "uf": F.nullif(F.trim("SG_ESTADO"), F.lit("")),
        "lat": _number(F.col("VL_LATITUDE")), "lon": _number(F.col("VL_LONGITUDE")), "elev_station": _number(F.col("VL_ALTITUDE")),
        "status": F.when(closed, "excluded").otherwise("included"), "exclusion_reason": F.when(closed, "inactive"),
        "source_meta": F.concat(F.lit("inmet_apitempo:/estacoes/T situacao="), F.coalesce(F.nullif(state, F.lit("")), F.lit("NA"))), "ingest_version": F.lit(ingest_version),
    })


def _canonical(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    out = df.select(*(columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in C.STATIONS))
    return C.validate(out, C.STATIONS, "stations")


def to_canonical(inmet: DataFrame, isd: DataFrame, ingest_version: str, inactive_end_cutoff: str | None = None) -> DataFrame:
    return inmet_to_canonical(inmet, ingest_version, inactive_end_cutoff).unionByName(isd_to_canonical(isd, ingest_version))


def check_final(stations: DataFrame) -> DataFrame:
    """Raises for exclusions without a reason and repeated ids."""
    row = stations.agg(F.count_if((F.col("status") != "included") & F.col("exclusion_reason").isNull()).alias("unexplained"), F.count(F.lit(1)).alias("n"), F.count_distinct("station_id").alias("ids")).first()
    if row["unexplained"] or row["n"] != row["ids"]:
        raise C.ContractError(f"stations: {row['unexplained']} unexplained exclusions, {row['n'] - row['ids']} repeated ids")
    return stations


def status_counts(stations: DataFrame) -> DataFrame:
    """Stations by status and reason; what a reason names behind a colon is folded."""
    return stations.groupBy("status", F.substring_index("exclusion_reason", ":", 1).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def find_station(stations: DataFrame, what: str) -> DataFrame:
    """By id, else by a part of the name."""
    return stations.where((F.col("station_id") == what) | F.upper("name").contains(what.upper()))


def dem_lookup(stations: DataFrame, tiles: DataFrame, size: int = 3600) -> DataFrame:
    """(station_id, tile, elev_dem) from a table of elevation tiles (tile, row, col, elevation) of one degree each.

    Row 0 is a tile's north edge. A point on the south or east edge takes the last row or column; without its tile or
    cell the elevation is null, never invented.
    """
    lat, lon = F.col("lat"), F.col("lon")
    cell = lambda x: F.least(F.lit(size - 1), F.greatest(F.lit(0), F.floor(x * size))).cast("int")
    at = stations.where("lat is not null and lon is not null").select("station_id", dem_tile(lat, lon).alias("tile"), cell(F.floor(lat) + 1 - lat).alias("row"), cell(lon - F.floor(lon)).alias("col"))
    return at.join(tiles.select("tile", "row", "col", F.col("elevation").cast("double").alias("elev_dem")), ["tile", "row", "col"], "left").select("station_id", "tile", "elev_dem")


#: Codes of the climate raster.
KOPPEN = {
    1: "Af", 2: "Am", 3: "Aw", 4: "BWh", 5: "BWk", 6: "BSh", 7: "BSk", 8: "Csa", 9: "Csb", 10: "Csc", 11: "Cwa", 12: "Cwb", 13: "Cwc", 14: "Cfa", 15: "Cfb", 16: "Cfc",
    17: "Dsa", 18: "Dsb", 19: "Dsc", 20: "Dsd", 21: "Dwa", 22: "Dwb", 23: "Dwc", 24: "Dwd", 25: "Dfa", 26: "Dfb", 27: "Dfc", 28: "Dfd", 29: "ET", 30: "EF",
}


def koppen_lookup(stations: DataFrame, raster: DataFrame, res: float) -> DataFrame:
    """(station_id, koppen) from a raster table (row, col, code) whose cell (0, 0) starts at -90, -180.

    A cell of code 0 (sea) takes the most common other code of its 3 x 3 cells, the smaller of equally common ones.
    """
    at = stations.select("station_id", F.floor((F.col("lat") + 90) / res).alias("r"), F.floor((F.col("lon") + 180) / res).alias("c"))
    around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("d")
    cells = at.select("station_id", around, "r", "c").select("station_id", ((F.col("d.i") == 0) & (F.col("d.j") == 0)).alias("own"), (F.col("r") + F.col("d.i")).alias("row"), (F.col("c") + F.col("d.j")).alias("col"))
    codes = cells.join(raster, ["row", "col"]).where("code > 0 or own")
    counts = codes.groupBy("station_id", "code").agg(F.count(F.lit(1)).alias("n"), F.max("own").alias("own"))
    best = counts.groupBy("station_id").agg(F.max(F.when(F.col("own") & (F.col("code") > 0), F.col("code"))).alias("own_code"), F.min_by(F.col("code"), F.when(F.col("code") > 0, F.struct(-F.col("n"), F.col("code")))).alias("vote"))
    names = F.create_map(*(F.lit(x) for kv in KOPPEN.items() for x in kv))
    return stations.select("station_id").join(best, "station_id", "left").select("station_id", F.try_element_at(names, F.coalesce("own_code", "vote").cast("int")).alias("koppen"))
