"""Fixed schemas of every table that crosses a stage, and the checks that hold them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _TS, _I16, _I32, _I64 = T.StringType(), T.DoubleType(), T.TimestampType(), T.ShortType(), T.IntegerType(), T.LongType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


OBS = _schema(station_id=_S, valid_time=_TS, variable=_S, value=_D, source=_S, source_qc_raw=_S, ingest_version=_S)
OBS_QC = T.StructType([*OBS.fields, T.StructField("qc_flags", _I32)])
FORECAST_POINTS = _schema(station_id=_S, model=_S, variable=_S, init_time=_TS, valid_time=_TS, lead_hours=_I16, value=_D, interp_method=_S, grid_lat=_D, grid_lon=_D, grid_elev=_D, ingest_version=_S)
FACT = _schema(station_id=_S, model=_S, variable=_S, init_time=_TS, valid_time=_TS, lead_hours=_I16, fcst_raw=_D, fcst_elev_adj=_D, obs=_D, delta_z=_D, interp_method=_S, repr_floor=_D, qc_flags=_I32, ingest_version=_S)
STATIONS = _schema(station_id=_S, network=_S, native_id=_S, name=_S, uf=_S, lat=_D, lon=_D, elev_station=_D, elev_dem=_D, koppen=_S, cross_ref=_S, status=_S, exclusion_reason=_S, source_meta=_S, ingest_version=_S)
RESULTS = _schema(metric=_S, comparison_id=_S, model=_S, variable=_S, lead_hours=_I16, stratum_type=_S, stratum_value=_S, estimate=_D, ci_low=_D, ci_high=_D, alpha=_D, n_pairs=_I64, n_stations=_I32, n_days=_I32, block_len_days=_I16, n_boot=_I32, p_raw=_D, p_adj=_D, family_id=_S, n_family=_I32, registry_version=_S, ingest_version=_S)
MANIFEST = _schema(url=_S, local_path=_S, sha256=_S, bytes=_I64, source=_S, model=_S, init_time=_TS, downloaded_at=_TS, status=_S)

#: QC bits; 64 and above are reserved. Flags mark rows, they never remove them.
RANGE, STEP, PERSISTENCE, SPATIAL, METADATA, DUPLICATE = 1, 2, 4, 8, 16, 32
BITS = {"RANGE": RANGE, "STEP": STEP, "PERSISTENCE": PERSISTENCE, "SPATIAL": SPATIAL, "METADATA": METADATA, "DUPLICATE": DUPLICATE}
ALL_BITS = 63


class ContractError(ValueError):
    """A table breaks its contract; the message lists everything that is wrong."""


class ReconciliationError(ValueError):
    """Rows in, rows out and dropped rows do not add up."""


def validate(df: DataFrame, schema: T.StructType, name: str, allow_extra: bool = False) -> DataFrame:
    """``df`` if its column names and types match; one error names every problem. Looks at the schema only."""
    have, want = {f.name: f.dataType for f in df.schema}, {f.name: f.dataType for f in schema}
    wrong = [f"missing column '{k}'" for k in want if k not in have]
    wrong += [f"column '{k}' is {have[k].simpleString()}, expected {t.simpleString()}" for k, t in want.items() if k in have and have[k] != t]
    if not allow_extra:
        wrong += [f"unexpected column '{k}'" for k in have if k not in want]
    if wrong:
        raise ContractError(f"{name}: " + "; ".join(wrong))
    return df


def require_non_null(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``df`` if none of the columns holds a null; one aggregate over all of them."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in columns)).first().asDict()
    if bad := {c: n for c, n in counts.items() if n}:
        raise ContractError(f"{name}: nulls in {bad}")
    return df


def reconcile(stage: str, rows_in: int, rows_out: int, dropped: Mapping[str, int]) -> dict:
    """The stage's log record, if rows_in = rows_out + all drops and no count is negative."""
    if min(rows_in, rows_out, *dropped.values(), 0) < 0:
        raise ReconciliationError(f"{stage}: negative count")
    if rows_in != rows_out + sum(dropped.values()):
        raise ReconciliationError(f"{stage}: {rows_in} rows in, {rows_out} out, dropped {dict(dropped)}")
    return {"stage": stage, "rows_in": rows_in, "rows_out": rows_out, "dropped": dict(dropped)}


def watched(tagged: DataFrame, reasons: Sequence[str], reason: str = "drop_reason") -> tuple[DataFrame, Observation]:
    """``tagged`` and an observation of its rows by drop reason, filled by the job that first uses the result: no second scan.

    Take ``reconciled`` after that job. A reason that is not named makes the counts differ, which raises there.
    """
    seen = Observation()
    counts = (F.count_if(F.col(reason) == r).alias(r) for r in reasons)
    return tagged.observe(seen, F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col(reason).isNull()).alias("rows_out"), *counts), seen


def reconciled(stage: str, seen: Observation) -> dict:
    """``reconcile`` of what an observation of ``watched`` has counted."""
    counts = dict(seen.get)
    return reconcile(stage, counts.pop("rows_in"), counts.pop("rows_out"), counts)


def describe(flags: Column) -> Column:
    """Names of the set bits, lowest first; null or negative flags raise when evaluated."""
    names = F.array(*(F.when(flags.bitwiseAND(bit) != 0, F.lit(name)) for name, bit in BITS.items()))
    return F.when(flags < 0, F.raise_error(F.lit("negative QC flags")).cast("array<string>")).otherwise(F.filter(names, lambda x: x.isNotNull()))


def is_clean(flags: Column, mask: int = ALL_BITS) -> Column:
    return flags.bitwiseAND(mask) == 0


def bit_counts(df: DataFrame, by: Sequence[str] = ("variable",)) -> DataFrame:
    """Rows, flagged rows by bit, and clean rows of every group."""
    flags = F.col("qc_flags")
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.count_if(flags.bitwiseAND(bit) != 0).alias(name.lower()) for name, bit in BITS.items()), F.count_if(flags == 0).alias("clean"))


# Units: kelvin, metres a second, millimetres.
def c_to_k(x: Column) -> Column:
    return x + 273.15


def k_to_c(x: Column) -> Column:
    return x - 273.15


def m_to_mm(x: Column) -> Column:
    return x * 1000.0


def wind_speed(u: Column, v: Column) -> Column:
    return F.hypot(u, v)


def scaled_tenths(raw: Column, missing: int = -9999) -> Column:
    """Integer tenths -> value; the missing mark -> null."""
    return F.when(raw != missing, raw / 10.0)
