"""Checks of gridded forecast fields, however they were decoded: units, time axis, fields that stand twice.

Fields come from ``grib`` and ``runs``, or as tables (short_name, units, lead_hours, init_time, valid_time, j, i, value).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.contracts import ContractError

#: Units in which the fields are used; rain is converted by its own units, never by assumption.
UNITS = {"2t": ("K",), "10u": ("m s-1", "m s**-1"), "10v": ("m s-1", "m s**-1"), "tp": ("m", "kg m-2", "kg m**-2", "mm")}
FIELD = ("model", "init_time", "lead_hours", "short_name")


def check_units(fields: DataFrame, units: Mapping[str, Sequence[str]] = UNITS) -> DataFrame:
    """``fields`` if every known field has one of its units; unknown fields pass. One row a pair of name and units is looked at."""
    bad = [(r["short_name"], r["units"]) for r in fields.select("short_name", "units").distinct().collect() if r["short_name"] in units and r["units"] not in units[r["short_name"]]]
    if bad:
        raise ContractError(f"unexpected units: {sorted(bad, key=str)}")
    return fields


def check_unique(fields: DataFrame, key: Sequence[str] = FIELD) -> DataFrame:
    """``fields`` if no node of a field stands twice."""
    twice = fields.groupBy(*key, "j", "i").agg(F.count(F.lit(1)).alias("n")).where("n > 1").first()
    if twice:
        raise ContractError(f"field stands twice: {twice.asDict()}")
    return fields


def check_leads(fields: DataFrame, step_hours: int = 6, most_hours: int = 240) -> DataFrame:
    """``fields`` if every lead is a whole number of steps within the run and every time is its run's plus the lead."""
    lead = F.col("lead_hours")
    off = (F.unix_seconds("valid_time") - F.unix_seconds("init_time")) != lead * 3600
    bad = fields.where((lead % step_hours != 0) | (lead < 0) | (lead > most_hours) | off).select("init_time", "valid_time", "lead_hours").first()
    if bad:
        raise ContractError(f"lead or time axis: {bad.asDict()}")
    return fields
